"""textloom: full-text retrieval and text analytics on Spark DataFrames."""
