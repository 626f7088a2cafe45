"""Operators for large text corpora: cleaning, de-duplication, search, tokenising and packing."""
