"""All registered queries."""

from kinespark.plans import (  # noqa: F401
    dataset_queries, model_queries, series_queries, source_queries, stream_queries,
)
from kinespark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
