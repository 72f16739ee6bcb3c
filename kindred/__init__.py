"""Identity and session analytics on Spark DataFrames."""
