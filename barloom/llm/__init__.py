"""Operators for training-data pipelines: duplicates, secrets, quality, contamination, sharding, search, tokens."""
