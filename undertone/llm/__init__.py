"""Operators for large text corpora (training-data preparation) on Spark DataFrames."""
