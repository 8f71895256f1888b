"""karvan: parts-market analytics as Spark DataFrame and Structured Streaming jobs."""
