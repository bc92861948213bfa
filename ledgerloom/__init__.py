"""Ledger investigation analytics on Spark: DataFrames in, DataFrames out."""
