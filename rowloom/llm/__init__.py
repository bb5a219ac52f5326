"""Operators of a training-data pipeline: tokens, language, search, duplicates, secrets, web archives, packing."""
