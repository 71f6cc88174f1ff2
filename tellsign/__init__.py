"""Message-risk analytics as Spark DataFrame jobs."""
