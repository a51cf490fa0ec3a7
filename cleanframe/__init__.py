"""cleanframe: data cleaning and profiling on Spark DataFrames."""
