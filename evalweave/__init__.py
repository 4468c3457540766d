"""Evaluation analytics over row-level model responses, as Spark DataFrame jobs."""
