"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator is a
function from DataFrames to a DataFrame; ``queries`` registers the queries.
"""
