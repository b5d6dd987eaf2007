"""Matched case-control cohort analytics on Spark DataFrames."""
