"""Fuzzy imputation and feature selection on Spark DataFrames."""
