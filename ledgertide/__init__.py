"""Text-and-market analytics as Spark DataFrame jobs."""
