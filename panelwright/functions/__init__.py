"""Column-level helpers: dates, numbers, strings and probabilities."""
