"""Cohesive-subgraph analytics on Spark."""
