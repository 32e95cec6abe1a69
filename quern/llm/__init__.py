"""Operators for large-scale training-data pipelines, each a Spark job over whole tables."""
