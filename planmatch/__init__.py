"""Best matches in a catalog when no row meets every wish, as Spark jobs."""
