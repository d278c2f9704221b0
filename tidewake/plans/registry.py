"""Queries of the movement and signal operators, and the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import entries, groups, tracks, video  # noqa: F401
from .views import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "entry"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[tracks.FLAGSHIP](spark, sf_dir)
