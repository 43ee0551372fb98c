"""Operators for large training-data pipelines.

Nothing outside this package imports it; ``queries`` holds the registered
queries and their SQL.
"""
