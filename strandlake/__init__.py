"""Retrieval and prefix-reuse analytics on Spark DataFrames."""
