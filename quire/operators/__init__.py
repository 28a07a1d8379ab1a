"""Operators: DataFrames to DataFrames, lazy, with every order and tie stated."""
