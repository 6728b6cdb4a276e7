"""Training-data operators: tokens, secrets, language, sharding, threads, dedup, quality, packing, decontamination."""
