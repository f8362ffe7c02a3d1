"""Panel analytics on Spark: cumulative daily counters, one row per entity and day."""
