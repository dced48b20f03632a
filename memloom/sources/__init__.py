"""Readers, writers and the projections that turn star-schema tables into memory tables."""
