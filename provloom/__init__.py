"""Provenance-first code-graph analytics on Spark DataFrames."""
