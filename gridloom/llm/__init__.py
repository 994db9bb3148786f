"""Operators of a training-data pipeline: deduplication, filters, formatting, tokens and search.

Nothing else in the library imports this subpackage. Each module holds one operator with its own
interface; ``queries`` registers one query for each of them.
"""
