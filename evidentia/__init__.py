"""Evidence retrieval over paginated documents, on Spark DataFrames."""
