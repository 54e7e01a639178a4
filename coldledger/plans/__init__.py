"""Whole queries: inputs derived from the given tables, and what runs on them."""
