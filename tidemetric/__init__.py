"""Experimentation analytics on Spark: metrics, inference and assignment as DataFrame jobs."""
