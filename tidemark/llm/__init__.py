"""Operators for preparing large training corpora, all on Spark DataFrames."""
