"""Hierarchical metric analytics on Spark DataFrames."""
