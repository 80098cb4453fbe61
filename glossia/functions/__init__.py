"""Scalar and window functions shared by all jobs."""
