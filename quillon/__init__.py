"""Vector, text and corpus analytics on Spark DataFrames."""
