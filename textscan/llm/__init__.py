"""Operators for preparing training text: filters, deduplication, scoring, tokens, packing and chat."""
