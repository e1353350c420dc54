"""Training-data pipeline operators: dedup, tokenisation, archives, quality, contamination, scoring, extraction, secrets."""
