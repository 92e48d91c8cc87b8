"""Vocabulary pipelines as Spark DataFrame functions."""
