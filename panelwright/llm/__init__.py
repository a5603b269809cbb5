"""Operators for training-data corpora: filtering, duplicates, packing, encoding and search."""
