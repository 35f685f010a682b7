"""Column expressions: no joins, no aggregation, no shuffle."""
