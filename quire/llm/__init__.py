"""Training-data operators: quality, licences, personal data, near-duplicates, language, tokens, mixing."""
