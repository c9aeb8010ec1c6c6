"""Operators that prepare training text: cleaning, deduplication, formatting, packing, scoring."""
