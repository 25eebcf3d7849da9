"""Dataset-reuse analytics on Spark DataFrames."""
