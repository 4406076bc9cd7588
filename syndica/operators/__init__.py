"""Relational operators: HTML trees, item tables, ordered ranges, freshness."""
