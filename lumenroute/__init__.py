"""Identify noisy observations of catalogue items with Spark, and act on the result."""
