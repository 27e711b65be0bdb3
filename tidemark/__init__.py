"""Calendar-driven incremental ingest of daily market tables, on Spark."""
