"""Operators of a training-data pipeline over text, page, chat and vector tables.

Nothing outside this subpackage imports it; ``plans`` registers its queries.
"""
