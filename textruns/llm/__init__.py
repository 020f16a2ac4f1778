"""Operators for preparing training text: scoring, filtering, deduplication, search, tokenisation and packing."""
