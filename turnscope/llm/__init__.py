"""Training-data operators: de-duplication, filtering, scoring and mixing of text corpora."""
