"""Analytics operators: each takes and returns Spark DataFrames."""
