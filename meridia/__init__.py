"""Spatial analytics on Spark DataFrames."""
