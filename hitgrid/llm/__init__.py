"""Training-data operators on Spark: filtering, deduplication, tokenising, packing and media."""
