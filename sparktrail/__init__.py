"""Process-trace analytics as Spark DataFrames."""
