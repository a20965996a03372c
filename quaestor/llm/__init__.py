"""Training-data operators: cleaning, scoring, deduplicating, mixing and formatting corpora."""
