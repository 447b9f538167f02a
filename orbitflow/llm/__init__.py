"""Training-data operators: dedup, quality, contamination, privacy, licences, tokens, language."""
