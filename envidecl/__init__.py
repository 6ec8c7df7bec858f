"""Analytics on environmental product declarations, declared as Spark DataFrames."""
