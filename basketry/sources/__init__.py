"""Readers with fixed schemas and writers with the stored layout."""
