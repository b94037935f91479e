"""Document-intelligence and retrieval analytics on Spark DataFrames."""
