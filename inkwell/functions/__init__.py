"""Column functions for addresses, texts and query strings."""
