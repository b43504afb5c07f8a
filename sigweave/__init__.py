"""Exact k-mer signature analysis of sequence collections on Spark DataFrames."""
