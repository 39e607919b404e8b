"""Nearest-neighbour imputation and multi-output prediction over Spark DataFrames."""
