"""Column builders: every function returns a Column and triggers no work."""
