"""Operators of a training-data pipeline: scoring, filtering, deduplication, sharding, mixing and encoding of documents."""
