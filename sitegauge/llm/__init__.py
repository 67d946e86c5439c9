"""Training-data operators: cleaning, scoring, deduplicating and formatting a corpus of documents."""
