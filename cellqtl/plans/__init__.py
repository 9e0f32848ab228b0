"""Queries on inputs derived from the test tables."""

from . import association, cohort, expression, files, metadata, products, queries, statistics  # noqa: F401
