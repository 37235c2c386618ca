"""Spark jobs that score corpora of PHP projects for upgrades and framework moves."""
