"""Operators for large text corpora: cleaning, deduplication, scoring and packing of training data."""
