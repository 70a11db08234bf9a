"""Column builders. Every function here returns a built-in Spark expression."""
