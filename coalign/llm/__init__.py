"""Operators for preparing large text corpora.

Each module holds one operator with its own interface; ``queries`` registers
the thin ``opN_`` queries over the ``documents`` and ``pages`` tables.
"""
