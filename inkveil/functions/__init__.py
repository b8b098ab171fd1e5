"""Functions of the inkveil engine."""
