"""Document-integrity analytics as Spark DataFrames."""
