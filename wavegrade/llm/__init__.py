"""Training-data operators: text in Spark tables in, scored, deduplicated, cleaned and packed text out."""
