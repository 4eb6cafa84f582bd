"""Operators: DataFrames plus options in, DataFrame out."""
