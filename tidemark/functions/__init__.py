"""Columns to columns: coercion, symbols, classes."""
