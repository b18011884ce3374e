"""Operators for building training corpora: deduplication, filtering, archiving and mixing."""
