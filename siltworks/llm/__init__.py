"""Training-data operators: near-duplicates, mixing, fingerprints, language, tokens, packing and more."""
