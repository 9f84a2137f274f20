"""tidewheel: panel analytics on Spark DataFrames."""
