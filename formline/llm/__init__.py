"""Corpus operators for training data: filters, token counts, deduplication, search and privacy."""
