"""Corpus preparation operators: scanning, filtering, deduplication and mixing of training text."""
