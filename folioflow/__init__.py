"""Document-evidence analytics on Spark DataFrames."""
