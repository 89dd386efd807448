"""Operators for training-data preparation. Nothing outside this package and ``corpus_pipeline`` imports it."""
