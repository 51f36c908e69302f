"""Event-stream, regression and survival analytics on Spark DataFrames."""
