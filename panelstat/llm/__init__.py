"""Training-data operators: text quality, tokens, near and exact duplicates,
mixing, fingerprints, secrets and licences. Each module holds one operator
with its own general interface; ``queries.py`` registers the thin queries."""
