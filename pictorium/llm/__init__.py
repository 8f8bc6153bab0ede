"""Operators of a training-data pipeline: archives, filters, duplicates, private data, tokens, packing."""
