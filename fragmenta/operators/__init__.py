"""Relational operators: interval joins, clustering, statistics, support counting, dedup."""
