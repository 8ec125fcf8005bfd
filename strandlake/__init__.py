"""Strandlake: k-mer analytics on Spark DataFrames."""
