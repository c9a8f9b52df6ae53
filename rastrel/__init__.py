"""Raster analytics on Spark: images as DataFrames, operators as DataFrame transformations."""

__version__ = "0.1.0"
