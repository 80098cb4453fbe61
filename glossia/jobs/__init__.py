"""Whole builds and the registered queries."""
