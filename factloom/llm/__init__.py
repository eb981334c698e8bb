"""Operators of a training-data pipeline: mixing, quality, duplicates, language, toxicity, shards, pseudonyms, packing."""
