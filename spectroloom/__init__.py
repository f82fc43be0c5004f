"""Spectral analytics on Spark: fixed-length vectors as array columns of DataFrames."""
