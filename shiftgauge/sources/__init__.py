"""Readers for code trees, manifests, registries and schema extracts, plus the small dimensions."""
