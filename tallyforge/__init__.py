"""Exact aggregate analytics over sharded tables, on Spark DataFrames."""
