"""Composite jobs that read tables, run operators and write tables."""
