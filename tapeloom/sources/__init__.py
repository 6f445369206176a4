"""Readers, record validation and page extraction."""
