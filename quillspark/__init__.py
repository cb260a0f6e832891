"""Full-text matching and relevance ranking on Spark DataFrames."""
