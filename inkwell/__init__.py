"""Inkwell: text-provenance analytics on Spark DataFrames."""
