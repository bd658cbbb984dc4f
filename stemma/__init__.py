"""Questions, retrieval, updates and schema changes over typed, linked tables, as Spark jobs."""
