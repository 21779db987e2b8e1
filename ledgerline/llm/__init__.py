"""Training-data operators: deduplication, filtering, tokenised output, formatting, scoring, packing and mixing."""
