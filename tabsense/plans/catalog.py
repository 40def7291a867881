"""All queries of the package, registered by importing their modules."""

from . import basic_queries, feature_queries, model_queries, quality_queries, statistics_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
