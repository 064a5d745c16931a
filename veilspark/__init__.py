"""Sensitive-data detection and text pipelines on Spark DataFrames."""
