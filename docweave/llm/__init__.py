"""Training-data operators: filters, deduplication, joins, mixing and sharding of text corpora."""
