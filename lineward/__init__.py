"""Sensitive-content scanning as Spark jobs."""
