"""Queries, set operations, preloads and writes."""
