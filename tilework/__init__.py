"""Grouped candidate ranking and its evaluation as Spark jobs."""
