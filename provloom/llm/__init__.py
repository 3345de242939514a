"""Operators for preparing training text, each built on DataFrames."""
