"""Point-in-time feature analytics on Spark."""
