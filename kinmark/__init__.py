"""Entity-name matching and group analytics on Spark DataFrames."""
