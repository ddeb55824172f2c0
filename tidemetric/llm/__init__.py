"""Operators for large training corpora: archives, extraction, filtering, dedup and mixing."""
