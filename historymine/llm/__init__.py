"""Operators that prepare training data: near-duplicates, archives, chat, classifiers, tokens, mixing, search, secrets."""
