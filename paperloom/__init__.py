"""Document-library and retrieval analytics on Spark DataFrames."""
