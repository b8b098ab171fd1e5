"""Streaming of the inkveil engine."""
