"""Segmentation and clustering-evaluation analytics on Spark DataFrames."""
