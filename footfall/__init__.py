"""Web access-log traffic analytics as Spark DataFrame jobs."""
