"""Document retrieval and retrieval evaluation as Spark jobs."""
