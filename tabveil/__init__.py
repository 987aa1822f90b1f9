"""Profiling, de-identification and corpus preparation on Spark DataFrames."""
