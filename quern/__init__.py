"""Document analytics and ranked retrieval on Spark DataFrames."""
