"""Operators over record, key and pair tables."""
