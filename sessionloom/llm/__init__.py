"""Training-data operators: extraction, quality, dedup, tokenizing, packing, scoring."""
