"""Training-data operators: tokenizing, sharding, deduplication, search, scanning, packing, scoring."""
