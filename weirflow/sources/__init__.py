"""Sources and sinks beyond plain Parquet tables."""
