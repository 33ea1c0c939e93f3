"""Readers, writers and importers for memory tables."""
