"""Competition analytics on Spark."""
