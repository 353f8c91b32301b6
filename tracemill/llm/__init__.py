"""Training-data operators: deduplication, quality, decontamination, tokens, packing, chat formatting."""
