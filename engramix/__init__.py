"""engramix: hybrid retrieval, memory analytics and corpus preparation on Spark."""
