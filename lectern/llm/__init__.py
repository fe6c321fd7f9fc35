"""Operators for preparing training data: deduplication, filtering, formatting, scoring and packing.

Nothing else in the library imports this subpackage. Queries are registered in
``lectern.llm.queries``.
"""
