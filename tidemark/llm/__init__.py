"""Operators of a large-scale training-data pipeline, each built as Spark jobs."""
