"""Operators for preparing training data of language models.

Nothing else in the library imports this package. Each module holds one
operator with its own general interface; ``queries`` applies them to the
driver tables.
"""
