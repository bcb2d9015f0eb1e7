"""Catalog data jobs as Spark DataFrames and streams."""
