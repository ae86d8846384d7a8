"""Operators for preparing training data: deduplication, filtering, tokenising, archives, chat."""
