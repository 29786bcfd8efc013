"""Spark operators for engagement-topology analytics."""
