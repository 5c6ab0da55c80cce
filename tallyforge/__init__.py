"""Content-performance analytics on Spark DataFrames."""
