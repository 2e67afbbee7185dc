"""Spatial point analytics and batch-dynamic k-d indexing on Spark DataFrames."""
