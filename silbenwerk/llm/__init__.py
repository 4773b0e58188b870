"""Training-data operators: token counts, joins, deduplication, scoring, mixing and media."""
