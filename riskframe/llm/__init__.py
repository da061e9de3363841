"""Operators for training-data pipelines: extraction, scoring, search, deduplication, mixing, sharding, tokens."""
