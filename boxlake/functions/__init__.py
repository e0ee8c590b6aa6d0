"""Column expressions: no action, no shuffle, no Python UDF."""
