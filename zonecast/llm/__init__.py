"""Training-data operators: quality, scoring, language, deduplication, packing, mixing, counts, URLs."""
