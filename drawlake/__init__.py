"""Posterior analytics on Spark DataFrames."""
