"""Sources of the inkveil engine."""
