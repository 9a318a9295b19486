"""Operators for preparing training data: deduplication, selection, scanning, tokenising and packing."""
