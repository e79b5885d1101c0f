"""Label compliance analytics as Spark DataFrame jobs."""
