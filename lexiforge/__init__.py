"""Spark-first analytics for language-to-logic text corpora."""
