"""echofold: near-duplicate analytics as Spark DataFrames."""
