"""factorloom: cross-sectional factor analytics as plain Spark DataFrame jobs."""
