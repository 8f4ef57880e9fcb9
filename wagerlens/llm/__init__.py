"""Operators for preparing training text: deduplication, scans, scoring, mixing, sharding."""
