"""The library's queries and their SQL twins, collected from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadlens.plans import aggregates, filters, joins, lifecycle, ordering, retrieval, streams, support, texts

MODULES: list = [filters, joins, aggregates, ordering, texts, retrieval, lifecycle, streams, support]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["top.vector_knn"](spark, sf_dir)
