"""Training-data operators: dedup, scans, archives, search, tokens and filters."""
