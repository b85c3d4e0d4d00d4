"""Parquet tables of a folder, and the removal of rows that were sent again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Table ``name`` of ``folder``; with ``columns`` only those, so that the scan reads nothing else."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def once(df: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """One row for each key. Rows sent again repeat all that is kept, so any of them will do; Spark drops repeats in each
    map task before it shuffles, which keeps a key that fills a third of the rows harmless."""
    return df.dropDuplicates([key] if isinstance(key, str) else list(key))
