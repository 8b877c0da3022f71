"""Operators of a training-data pipeline: token counts, packing, duplicates, quality, search and extraction."""
