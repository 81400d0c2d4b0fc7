"""Report-archive analytics on Spark."""
