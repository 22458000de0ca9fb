"""Registered queries of the core operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.instants import manifest_instants
from ..runtime import table
from . import detail_queries, review_queries, scan_queries


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return manifest_instants(table(spark, d, "migration_manifest"), table(spark, d, "takeout_sidecar"), table(spark, d, "scan_source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p3_found": p3_found} | scan_queries.QUERIES | review_queries.QUERIES | detail_queries.QUERIES
