"""Item-graph analytics on Spark DataFrames."""
