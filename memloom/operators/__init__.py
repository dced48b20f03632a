"""Operators over the memory tables; each takes and returns lazy DataFrames."""
