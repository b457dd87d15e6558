"""Operators for large training corpora: text, page and vector tables in, DataFrames out."""
