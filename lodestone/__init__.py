"""lodestone: the data side of retrieval systems as Spark DataFrame jobs."""
