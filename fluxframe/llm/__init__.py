"""Operators of a training-data pipeline: filters, near duplicates, language models, tokens, personal data, search."""
