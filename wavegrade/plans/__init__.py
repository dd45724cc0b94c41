"""From named queries to DataFrames."""
