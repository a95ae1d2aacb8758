"""Document analytics on Spark: batch search, chunking, retrieval and corpus preparation."""
