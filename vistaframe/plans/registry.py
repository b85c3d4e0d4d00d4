"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vistaframe.plans import records, scene_queries, score_queries, table_queries, vector_queries

MODULES = (scene_queries, table_queries, score_queries, vector_queries)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return scene_queries.prominence_class(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return records.QUERIES | {name: f for m in MODULES for name, f in m.catalogue.queries.items()}


def oracle_sql() -> dict[str, str]:
    return records.ORACLE | {name: sql for m in MODULES for name, sql in m.catalogue.sql.items()}
