"""Registry of the engine's own queries and of their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from braidwork import pipeline
from braidwork.plans import oracles
from braidwork.plans import queries as plans


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["hybrid_retrieve"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return plans.all_queries() | {"build_graph": pipeline.build_graph}


def oracle_sql() -> dict[str, str]:
    return oracles.all_oracles()
