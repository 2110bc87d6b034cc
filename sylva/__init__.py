"""Decision-forest analytics on Spark DataFrames."""
