"""Evaluation and metrics analytics on Spark."""
