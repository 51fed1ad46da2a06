"""Training-data operators: packing, language id, sharding, deduplication, search, safety."""
