"""inkveil: find, judge and remove personal data in large text collections with Spark."""
