"""Training-data operators: deduplication, sharding, tokens, search, extraction, packing."""
