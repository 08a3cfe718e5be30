"""Grounded-synthesis analytics on Spark DataFrames."""
