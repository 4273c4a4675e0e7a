"""Composed plans: scan, clean, verify; and the registry of queries with their SQL."""
