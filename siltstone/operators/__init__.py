"""Relational operators of the store."""
