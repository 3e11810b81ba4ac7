"""Spark-first domain-shift correction: importance weights, selection, evaluation and run tables."""
