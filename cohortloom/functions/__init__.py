"""Column expressions: no DataFrame, no action, no row-at-a-time UDF."""
