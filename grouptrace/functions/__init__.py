"""Column-returning functions, all composed of Spark built-ins."""
