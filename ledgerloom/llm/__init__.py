"""Operators for preparing training text: filters, deduplication, search and mixing.

Nothing outside this folder imports it; ``queries.py`` registers its queries.
"""
