"""Landed tables, catalogs, day-partitioned tables and run manifests."""
