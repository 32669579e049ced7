"""Schemas and tables on disk."""
