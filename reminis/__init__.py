"""Memory retrieval and analytics on Spark."""
