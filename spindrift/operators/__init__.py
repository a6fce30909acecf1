"""Relational operators of the engine: each takes and returns DataFrames."""
