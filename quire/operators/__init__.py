"""DataFrame-to-DataFrame operators: as-of joins, islands, interval coalescing, ranking."""
