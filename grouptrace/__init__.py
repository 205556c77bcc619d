"""Corporate-registry and group-ownership analytics as PySpark DataFrame jobs."""
