"""Retrieval and indexing of large libraries of text-bearing items, expressed as Spark DataFrames."""
