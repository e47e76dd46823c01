"""Column expressions: text, numbers, dates, geometry. All are built of Spark's own functions."""
