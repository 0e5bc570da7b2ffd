"""World-event analytics on Spark DataFrames."""
