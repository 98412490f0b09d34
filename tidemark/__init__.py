"""Querying, storing and publishing signed events as Spark DataFrames."""
