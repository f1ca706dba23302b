"""Street-segment analytics expressed as Spark DataFrame jobs."""
