"""Analytics of charging sessions with Spark DataFrames."""
