"""Batch name screening and corpus preparation on Spark DataFrames."""
