"""tidewrack: website and search-visibility analytics on Spark DataFrames."""
