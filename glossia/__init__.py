"""Spark jobs for keyed markup corpora."""
