"""Session-activity analytics on Spark DataFrames and Structured Streaming."""
