"""Training-data operators: extraction, filtering, deduplication, scoring, tokenising, search."""
