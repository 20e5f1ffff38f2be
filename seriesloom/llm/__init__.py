"""Operators for preparing training text: near-duplicates, quality, tokens, mixing, search."""
