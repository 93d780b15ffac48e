"""Raster, stroke and document analytics on PySpark DataFrames."""
