"""Operators over DataFrames: none knows a table's name."""
