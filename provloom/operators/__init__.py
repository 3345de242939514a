"""Relational and graph operators, DataFrames in and out."""
