"""Operators of a training-data pipeline: tokens, archives, filters, near-duplicates, packing and sharding."""
