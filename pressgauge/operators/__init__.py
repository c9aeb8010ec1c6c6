"""Relational operators: merges, rollups, search, enrichment and the designed coverage metrics."""
