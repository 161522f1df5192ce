"""Document-intelligence analytics as Spark jobs."""
