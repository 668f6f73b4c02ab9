"""Place-name corpus analytics on Spark DataFrames."""
