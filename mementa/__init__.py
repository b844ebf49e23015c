"""Content deduplication and backup analytics expressed as Spark DataFrame operators."""
