"""Operators for preparing training text: fingerprints, near duplicates, shards, tokens, filters."""
