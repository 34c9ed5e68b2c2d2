"""Pure functions from DataFrames to DataFrames."""
