"""Column expressions: text, path and version functions, and the fixed values they use."""
