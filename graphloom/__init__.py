"""Sparse-graph ordering and analytics on Spark DataFrames."""
