"""Queries over the archive's tables."""
