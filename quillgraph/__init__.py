"""Knowledge-graph retrieval over documents, as Spark DataFrames."""
