"""Spark-first engine for adaptive sparse-grid computation and training-data pipelines."""
