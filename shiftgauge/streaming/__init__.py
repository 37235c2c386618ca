"""The per-file features and project tallies over a stream of arriving files."""
