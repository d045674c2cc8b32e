"""Relational operators: cleaning, deduplication, incremental runs, search, findings."""
