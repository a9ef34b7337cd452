"""Training-data operators: decontamination, toxicity, deduplication, archives, quality, PII, ANN, packing."""
