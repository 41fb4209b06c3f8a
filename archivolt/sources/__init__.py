"""Readers and writers of the archive."""
