"""DataFrame operators. Each takes DataFrames and returns lazy DataFrames."""
