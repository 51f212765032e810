"""Scanlines, pixels, symbols, bands and container chunks as Spark DataFrames."""
