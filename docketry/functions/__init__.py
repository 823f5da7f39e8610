"""Column expressions. Every function takes and returns Columns; none uses a Python UDF."""
