"""Exact algebra over large immutable sets of 32-bit ids, declared as DataFrames."""
