"""Relational operators of the engine, each a function on DataFrames."""
