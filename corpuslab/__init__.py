"""corpuslab: corpus preparation, retrieval and retrieval evaluation as Spark jobs."""
