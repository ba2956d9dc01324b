"""Sparse methylome analytics as Spark DataFrame transformations."""
