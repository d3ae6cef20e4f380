"""Training-data operators: scoring, search, near-duplicate joins, tokenization, filtering, archives and packing."""
