"""Training-data operators: scans, deduplication, tokens, packing, scoring."""
