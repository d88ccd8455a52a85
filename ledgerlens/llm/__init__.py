"""Operators of a training-data pipeline: counting, packing, deduplicating and scoring texts."""
