"""Document analytics as Spark DataFrame jobs."""
