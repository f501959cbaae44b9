"""Readers, writers and validation of the stored tables."""
