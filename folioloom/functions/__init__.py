"""Column functions: expressions over built-in Spark functions."""
