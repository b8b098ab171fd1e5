"""Operators of the inkveil engine."""
