"""Training-data operators: quality, fingerprints, near-duplicates, tokens, packing, sharding, extraction."""
