"""Expression trees over sets and their compilation to one aggregate."""
