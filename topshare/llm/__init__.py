"""Operators for training data: one module each, queries and SQL in ``queries``."""
