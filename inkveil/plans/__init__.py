"""Plans of the inkveil engine."""
