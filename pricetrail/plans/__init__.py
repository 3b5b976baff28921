"""Operators put together into jobs and registered queries."""
