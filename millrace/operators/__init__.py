"""Relational operators: each is a function from DataFrames or Columns to DataFrames or Columns."""
