"""Operators of the aggregate engine."""
