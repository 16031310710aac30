"""Evaluation of classifiers on labelled tables, as Spark DataFrame operations."""
