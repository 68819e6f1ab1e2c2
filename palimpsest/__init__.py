"""Change analytics over versioned documents, on Spark DataFrames."""
