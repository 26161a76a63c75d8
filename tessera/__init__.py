"""Knowledge-graph, retrieval and training-data analytics on Spark."""
