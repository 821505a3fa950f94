"""Vector-layout analytics on Spark DataFrames."""
