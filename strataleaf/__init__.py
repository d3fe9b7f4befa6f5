"""Source-code and corpus analytics on Spark."""
