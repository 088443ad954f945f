"""lexivane: hybrid retrieval, ranking and corpus processing as Spark plans."""
