"""Training-data operators: search, filters, deduplication, fingerprints, tokens, scoring and mixing."""
