"""Source-structure graph analytics on Spark."""
