"""Corpus and sequence analytics as Spark DataFrame jobs."""
