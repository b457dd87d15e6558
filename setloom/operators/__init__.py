"""Set operators over DataFrames."""
