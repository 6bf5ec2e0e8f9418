"""Comparative-genomics style analytics on Spark DataFrames."""
