"""Clustering analytics over Spark DataFrames."""
