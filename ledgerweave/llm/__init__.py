"""Training-data operators: quality, toxicity, deduplication, packing, filtering and tokenising."""
