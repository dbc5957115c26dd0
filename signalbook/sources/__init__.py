"""Readers, writers and the star schema derived from the raw tables."""
