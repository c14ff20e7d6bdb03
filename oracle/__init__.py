"""Plain SQL statements (DuckDB dialect) for the same results, used as an independent check."""
