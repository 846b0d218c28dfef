"""Spark-first knowledge-graph analytics over time-stamped records."""
