"""City-data analytics expressed as Spark DataFrame, SQL and Structured Streaming jobs."""
