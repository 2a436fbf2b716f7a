"""Spark jobs for choosing, annotating and scoring labelled sequence data."""

UNKNOWN = -100
"""Tag id that stands for "not annotated" in tag arrays."""
