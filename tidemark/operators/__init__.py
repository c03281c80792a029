"""Operators: DataFrames in, a DataFrame out, lazy, with explicit tie keys."""
