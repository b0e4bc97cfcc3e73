"""Build, check and score text-to-SQL corpora with Spark."""
