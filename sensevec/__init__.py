"""Multi-sense word embeddings as PySpark DataFrame jobs."""
