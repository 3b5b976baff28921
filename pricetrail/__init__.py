"""Retail price tracking on Spark: page snapshots in, change-only price history out."""
