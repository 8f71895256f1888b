"""Training-data operators: scoring, filtering, deduplication, mixing, search and encoding."""
