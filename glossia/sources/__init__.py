"""Readers and writers of records, entries, media and reports."""
