"""Check queries: documents rendered from the given tables, and what they should yield."""
