"""Market tick and bar analytics on Spark."""
