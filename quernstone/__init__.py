"""Analytics for text, file metadata and source code on Spark DataFrames."""
