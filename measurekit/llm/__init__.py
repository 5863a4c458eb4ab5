"""Operators over text corpora: quality, duplicates, private data, mixing, packing and scoring."""
