"""Analytics of price quotes from many sources, as Spark DataFrames."""
