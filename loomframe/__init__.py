"""Spark-first analytics over timed records, sample tables, graphs and signals."""
