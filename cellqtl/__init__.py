"""Spark-first library for single-cell expression and QTL summary-statistics data."""
