"""Readers, writers and the mapping of raw logs to the canonical table."""
