"""Choose and apply the proportions of text domains with Spark DataFrames."""
