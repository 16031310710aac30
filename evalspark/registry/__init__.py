"""Registered queries over the tables of a data folder."""

from evalspark.registry import column_queries, feature_queries, report_queries, sampling_queries, scoring_queries  # noqa: F401
from evalspark.registry.base import QUERIES, SQL  # noqa: F401
