"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .metric_queries import QUERIES
from .model_queries import MODEL_QUERIES
from .profile_queries import PROFILE_QUERIES
from .readiness_queries import READINESS_QUERIES
from .storage_queries import STORAGE_QUERIES

ALL = QUERIES | MODEL_QUERIES | READINESS_QUERIES | STORAGE_QUERIES | PROFILE_QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items()}
