"""Lowering of queries to DataFrames."""
