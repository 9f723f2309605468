"""lodestone: note indexing, hybrid retrieval and retrieval evaluation as PySpark plans."""
