"""Column builders: every function returns a native Spark expression."""
