"""Multi-timescale window aggregation on Spark DataFrames."""
