"""Readers for snapshots and responses, writers for the stored tables."""
