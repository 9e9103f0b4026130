"""Training-data operators: sharding, search, mixing, filtering and de-duplication."""
