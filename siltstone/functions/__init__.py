"""Scalar functions over vectors."""
