"""Operators of a training-data pipeline: packing, filters, near-duplicates, tokens, models, search."""
