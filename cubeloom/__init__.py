"""Raster cubes as Spark DataFrames."""
