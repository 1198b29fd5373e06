"""Training-data operators: deduplication, search, tokens, language, mixing, chat, licences, URLs."""
