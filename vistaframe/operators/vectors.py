"""Operators on frames of vectors that need other rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaframe.functions.arrays import dot


def contrastive_loss(df: DataFrame, batch: str, key: str, student: str, teacher: str, temperature: float = 0.07) -> DataFrame:
    """(batch, n, loss): cross-entropy of each student vector against the batch's teachers, its own the right one.

    Unit vectors are expected. Pairs are made within a batch only, whose size is the trainer's; a batch of one has loss 0."""
    a = df.select(batch, F.col(key).alias("_i"), F.col(student).alias("_s"))
    b = df.select(batch, F.col(key).alias("_j"), F.col(teacher).alias("_t"))
    scored = a.join(b, batch).select(batch, "_i", (F.col("_i") == F.col("_j")).alias("_own"), (dot(F.col("_s"), F.col("_t")) / temperature).alias("_x"))
    # cosines lie between -1 and 1, so no score is above 1 / temperature: shifted by that, the sum needs no maximum first
    most = 1.0 / temperature
    row = scored.groupBy(batch, "_i").agg(F.sum(F.exp(F.col("_x") - most)).alias("_sum"), F.max(F.when(F.col("_own"), F.col("_x"))).alias("_right"))
    return row.select(batch, F.log(F.col("_sum") / F.exp(F.col("_right") - most)).alias("_loss")).groupBy(batch).agg(F.count("*").alias("n"), F.avg("_loss").alias("loss"))
