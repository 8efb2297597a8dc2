"""Bank-statement analytics on Spark DataFrames."""
