"""Training-data operators: language ID, search, extraction, packing, scoring, sharding, dedup, token files, URL filters, decontamination."""
