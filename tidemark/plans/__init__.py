"""Whole ingest runs."""
