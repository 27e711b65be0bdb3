"""DataFrames to DataFrames: calendar planning, normalising, validation, quality."""
