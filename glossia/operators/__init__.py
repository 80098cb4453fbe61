"""Operators over records, markup, redirects, the index and media."""
