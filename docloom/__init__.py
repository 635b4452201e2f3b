"""docloom: document ingestion, cleaning and exact vector search on Spark."""
