"""Operators for large text corpora: one module for each, and queries.py that registers them."""
