"""Operators for large training corpora: one module per operator, queries in ``queries.py``."""
