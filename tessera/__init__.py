"""tessera: search, ranking and relational analytics on Spark DataFrames."""
