"""Event-memory analytics on Spark."""
