"""Operators on text corpora: scoring, duplicates, mixing, packing, formatting and search."""
