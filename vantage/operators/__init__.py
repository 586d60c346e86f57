"""DataFrame operators: take and return DataFrames."""
