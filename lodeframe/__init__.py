"""lodeframe: declaration search and text-corpus operators as Spark DataFrame jobs."""
