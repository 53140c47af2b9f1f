"""Operators over DataFrames of vectors, nodes and edges."""
