"""Scalar semantics that differ from Spark's own."""
