"""Operators for large text corpora (training-data preparation)."""
