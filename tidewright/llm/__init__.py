"""Operators of a training-data pipeline: mixing, deduplication, filters, scoring, sharding and chat formatting."""
