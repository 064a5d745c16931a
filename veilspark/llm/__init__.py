"""Training-data operators: quality, deduplication, decontamination, mixing, scoring, extraction."""
