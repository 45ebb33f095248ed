"""Training-data operators: filters, deduplication, extraction, decontamination and mixing of text corpora."""
