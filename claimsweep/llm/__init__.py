"""Operators of a training-data pipeline: sharding, deduplication, filters, tokenizers, mixing, search."""
