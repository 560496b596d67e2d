"""Property graphs of source trees, as Spark DataFrames."""
