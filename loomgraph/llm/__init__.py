"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Each operator module keeps a
general interface over DataFrames; ``queries.py`` holds the thin registered
queries that derive contract columns from those operators.
"""
