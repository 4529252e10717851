"""Training-data operators: search, dedup, mixing, filters, language, leaks, toxicity, secrets."""
