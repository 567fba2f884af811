"""Payment-risk analytics as PySpark DataFrame and Structured Streaming jobs."""
