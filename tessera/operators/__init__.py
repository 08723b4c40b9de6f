"""Relational operators of the retrieval engine: DataFrames in, DataFrames out."""
