"""Analytics over query operations and metadata, as DataFrames."""
