"""Training-data operators: token counts, dedup, quality, PII, packing and the like."""
