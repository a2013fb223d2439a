"""Anomaly analytics over Spark DataFrames: vectors, rasters, instances, event streams."""
