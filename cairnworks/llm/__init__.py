"""Operators for preparing training data: deduplication, filtering, counting and packing."""
