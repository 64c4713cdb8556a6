"""Operators of a training-data pipeline: cleaning, scanning, deduplication and packing."""
