"""DuckDB statements that recompute each query from the raw tables, written independently of the Spark operators."""
