"""Operators for training-data corpora: text quality, duplicates, tokens, scans and filters."""
