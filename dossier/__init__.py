"""Evidence tables on Spark: scans, coverage, merging, review, specs, decks, reports and their streaming twins."""
