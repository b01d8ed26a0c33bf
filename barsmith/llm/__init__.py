"""Operators for training-data corpora: language, mixing, tokens, quality, duplicates, archives, pages."""
