"""Spatial graph completion and training-data preparation as Spark DataFrame operators."""
