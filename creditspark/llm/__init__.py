"""Operators for building training data: mixing, quality, deduplication, formatting, sharding, packing, search."""
