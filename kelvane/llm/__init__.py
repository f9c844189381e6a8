"""Training-data operators: cleaning, deduplication, filtering, packing and auditing of text corpora."""
