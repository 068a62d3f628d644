"""Analytics for scholarly corpora and similar collections, on Spark DataFrames."""
