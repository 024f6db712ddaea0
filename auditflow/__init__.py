"""Sensitive-data audit over tables and streams of texts, as plain PySpark DataFrame jobs."""
