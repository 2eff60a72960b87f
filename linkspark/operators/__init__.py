"""Operators on DataFrames: linkage, vectors, matrices, shares."""
