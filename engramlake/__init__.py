"""Agent-memory analytics on Spark DataFrames: scans, vectors, graphs, recall and versioned records."""
