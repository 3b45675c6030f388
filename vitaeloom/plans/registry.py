"""Registered queries of the core and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitaeloom.plans import oracle
from vitaeloom.plans import queries as q


def entry(spark: SparkSession, folder: str) -> DataFrame:
    return q.job_scores(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return q.all_queries()


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
