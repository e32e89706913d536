"""kinfold: near-duplicate analytics on Spark DataFrames."""
