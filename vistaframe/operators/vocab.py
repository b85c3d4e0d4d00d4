"""Vocabularies by first appearance, and encoding with them.

Ids follow the first appearance of a token, found by one aggregation; the numbering has no global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaframe.functions.arrays import padded
from vistaframe.operators.ranking import sequential_ids

PAD, UNK, LENGTH = 0, 1, 15


def word_vocabulary(df: DataFrame, order: str, tokens: Column, first: int = 2) -> DataFrame:
    """(token, id): ids from first by the first appearance (row by order, then place)."""
    placed = df.select(F.col(order).alias("row"), F.posexplode(tokens).alias("pos", "token"))
    seen = placed.groupBy("token").agg(F.min(F.struct("row", "pos")).alias("at"))
    return sequential_ids(seen, ["at", "token"], "id", first).select("token", "id")


def answer_vocabulary(df: DataFrame, order: str, answer: Column) -> DataFrame:
    """(token, id): ids from 0 by the first row of an answer."""
    seen = df.select(answer.alias("token"), F.col(order).alias("row")).where(F.col("token").isNotNull()).groupBy("token").agg(F.min("row").alias("at"))
    return sequential_ids(seen, ["at", "token"], "id", 0).select("token", "id")


def encoded(df: DataFrame, key: str, tokens: Column, vocabulary: DataFrame, length: int = LENGTH) -> DataFrame:
    """(<key>, ids): the first length tokens as ids, unknown ones as 1, filled with 0. Only these tokens are joined; the
    vocabulary grows with the corpus, so Spark chooses how."""
    placed = df.select(F.col(key).alias(key), F.posexplode_outer(F.slice(tokens, 1, length)).alias("pos", "token"))
    joined = placed.join(vocabulary, "token", "left").select(key, "pos", F.when(F.col("token").isNotNull(), F.coalesce("id", F.lit(UNK))).alias("id"))
    grouped = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id")))).alias("s"))
    return grouped.select(key, padded(F.transform("s", lambda s: s["id"]), length, PAD).alias("ids"))


def known(df: DataFrame, token: str, vocabulary: DataFrame) -> DataFrame:
    """Rows whose token is in the vocabulary."""
    return df.join(vocabulary.select(F.col("token").alias(token)), token, "left_semi")


def class_ids(df: DataFrame, answer: Column, vocabulary: DataFrame, default: int = 0) -> DataFrame:
    """df with class_id of its answer, the default if unknown."""
    named = vocabulary.select(F.col("token").alias("_token"), F.col("id").alias("_id"))
    return df.withColumn("_answer", answer).join(named, F.col("_answer") == F.col("_token"), "left").withColumn("class_id", F.coalesce("_id", F.lit(default))).drop("_answer", "_token", "_id")
