"""Readers that turn feeds, listings, page stores and dimension files into DataFrames."""
