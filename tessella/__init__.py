"""Chunked array analytics on Spark DataFrames."""
