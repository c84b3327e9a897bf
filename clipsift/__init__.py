"""Search, curation and export of large tables of clip embeddings on Spark."""
