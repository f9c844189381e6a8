"""Sparse-matrix and graph analytics on Spark DataFrames."""
