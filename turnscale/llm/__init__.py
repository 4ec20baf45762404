"""Training-data operators: scanning, archiving, mixing, sharding, deduplication, search, scoring, tokens."""
