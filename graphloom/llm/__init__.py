"""Operators for preparing training corpora. Nothing outside this package and corpus_pipeline imports it."""
