"""Operators on change logs as DataFrames, for callers with tables of their own."""
