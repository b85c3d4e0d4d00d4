"""Ranks, ids and prefixes over rows.

A window over the whole table would run in one task. Sequential ids are made instead from a range partitioning: each
partition is sorted and numbered on its own, and the counts of the partitions (one number a partition, on the driver) give
the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vistaframe.session import cut


def sequential_ids(df: DataFrame, order: Sequence[Column | str], name: str, first: int = 1) -> DataFrame:
    """df with consecutive BIGINT ids by an order that ends in a unique key. The sorted rows are written once, so that the
    numbering reads what the counting read."""
    part = F.spark_partition_id()
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_ = cut(df.orderBy(*order).select("*", part.alias("_part"), place.alias("_place")), "ids")
    counts = sorted(map(tuple, sorted_.groupBy("_part").count().collect()))  # one row for each partition
    starts, at = [], first
    for part_id, n in counts:
        starts.append((part_id, at))
        at += n
    table = df.sparkSession.createDataFrame(starts, "_part int, _offset long")
    joined = sorted_.join(F.broadcast(table), "_part")
    return joined.withColumn(name, F.col("_offset") + F.col("_place")).drop("_part", "_place", "_offset")


def zipped_by_position(a: DataFrame, b: DataFrame, order_a: Sequence[Column | str], order_b: Sequence[Column | str]) -> DataFrame:
    """The columns of both, row by row in their orders (which end in unique keys); an error if one is longer. Column names must
    differ. Both are numbered and joined by number, so neither is brought to one place."""
    left, right = sequential_ids(a, order_a, "_rn"), sequential_ids(b, order_b, "_rn")
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows and {m} rows")
    return left.join(right, "_rn").drop("_rn")


def prefix(df: DataFrame, order: Sequence[Column | str], share: float) -> DataFrame:
    """The first floor(n * share) rows; the product is one of doubles, as in the reference."""
    numbered = sequential_ids(df, order, "_rn")
    n = df.count()
    return numbered.where(F.col("_rn") <= int(n * share)).drop("_rn")


def batches(df: DataFrame, order: Sequence[Column | str], size: int, drop_last: bool = False) -> DataFrame:
    """df with batch_id from 0; with drop_last without the rows of an unfinished batch."""
    numbered = sequential_ids(df, order, "_rn")
    out = numbered.withColumn("batch_id", F.floor((F.col("_rn") - 1) / size).cast("long"))
    if drop_last:
        out = out.where(F.col("batch_id") < df.count() // size)
    return out.drop("_rn")


def padded_batches(df: DataFrame, order: Sequence[Column | str], values: str, size: int, fill: Column) -> DataFrame:
    """df with batch_id and its array of values filled up to the longest of the batch."""
    numbered = cut(batches(df, order, size), "batches")
    widths = numbered.groupBy("batch_id").agg(F.max(F.size(values)).alias("_width"))
    filled = F.concat(values, F.array_repeat(fill, F.col("_width") - F.size(values)))
    return numbered.join(widths, "batch_id").withColumn(values, filled).drop("_width")


def capped(df: DataFrame, key: Sequence[str], order: Sequence[Column | str], most: int) -> DataFrame:
    """At most so many rows of a key, the first by order. Spark limits each map task's groups before the shuffle, so a key
    that fills the table sends no more than its cap from each task."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_rn") <= most).drop("_rn")


def prominence_rows(df: DataFrame, scene: str, obj: str, area: Column, depth: Column, pos: Column, ratio: float = 1.3) -> DataFrame:
    """(scene, obj) most prominent in each scene, for scenes that come as rows; all windows share one exchange by scene."""
    base = df.select(F.col(scene).alias("scene"), F.col(obj).alias("obj"), area.alias("area"), depth.alias("depth"), pos.alias("pos"))
    w = Window.partitionBy("scene")
    r = base.withColumn("ar", F.row_number().over(w.orderBy(F.desc("area"), "pos")))
    r2 = (
        r.withColumn("dr", F.row_number().over(w.orderBy("depth", "ar")))
        .withColumn("n", F.count("*").over(w))
        .withColumn("a1", F.max(F.when(F.col("ar") == 1, F.col("area"))).over(w))
        .withColumn("a2", F.max(F.when(F.col("ar") == 2, F.col("area"))).over(w))
    )
    o = r2.groupBy("scene", "obj").agg((F.max("ar") + F.max("dr")).alias("score"), F.min("ar").alias("first"), F.first("n").alias("n"), F.first("a1").alias("a1"), F.first("a2").alias("a2"))
    key = F.when((F.col("n") == 1) | (F.col("a1") > ratio * F.col("a2")), F.col("first")).otherwise(F.col("score"))
    return o.groupBy("scene").agg(F.min_by("obj", F.struct(key, "first")).alias("obj"))


def next_available(df: DataFrame, order: str, value: str, group: str) -> DataFrame:
    """df with ``available``: the value of the row or of the next one in the group that has any, from the start again at the
    end; NULL if none has."""
    w = Window.partitionBy(group).orderBy(order)
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    start = F.first(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("available", F.coalesce(ahead, start))


def best_trial(df: DataFrame, trial: str, value: str) -> DataFrame:
    """(trial, best) of the trial with the least value of all its rows; ties to the lesser trial; NULL and NaN values do not count."""
    known = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return known.groupBy().agg(F.min_by(trial, F.struct(value, trial)).alias(trial), F.min(value).alias("best"))


def pruned(df: DataFrame, trial: str, step: str, value: str, warmup: int = 0) -> DataFrame:
    """(trial, step) at which a trial is given up: the first after the warm-up whose best value so far is worse than the median
    of the other trials' best values at that step. Trials and steps are a tuner's, so a step's values are few."""
    w = Window.partitionBy(trial).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = df.where(F.col(value).isNotNull()).withColumn("_best", F.min(value).over(w)).select(F.col(trial).alias("_trial"), F.col(step).alias("_step"), "_best")
    mine = best.select("_trial", "_step", F.col("_best").alias("_mine"))
    others = best.select(F.col("_trial").alias("_other"), "_step", "_best")
    worse = mine.join(others, "_step").where(F.col("_trial") != F.col("_other")).groupBy("_trial", "_step", "_mine").agg(F.median("_best").alias("_median")).where((F.col("_mine") > F.col("_median")) & (F.col("_step") > warmup))
    return worse.groupBy(F.col("_trial").alias(trial)).agg(F.min("_step").alias(step))


def early_stop(df: DataFrame, run: str, epoch: str, loss: str, patience: int) -> DataFrame:
    """(run, best, best_epoch, stop_epoch): training ends when the loss has not improved for so many epochs; NULL if it
    never does. Ties do not improve."""
    w = Window.partitionBy(run).orderBy(epoch)
    seen = df.withColumn("_before", F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    better = seen.withColumn("_better", F.col("_before").isNull() | (F.col(loss) < F.col("_before")))
    last = better.withColumn("_last", F.max(F.when(F.col("_better"), F.col(epoch))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    stop = F.min(F.when(F.col(epoch) - F.col("_last") >= patience, F.col(epoch)))
    ended = last.withColumn("_stop", stop.over(Window.partitionBy(run)))
    kept = ended.where(F.col("_stop").isNull() | (F.col(epoch) <= F.col("_stop")))
    return kept.groupBy(run).agg(F.min(loss).alias("best"), F.min_by(epoch, F.struct(loss, epoch)).alias("best_epoch"), F.first("_stop").alias("stop_epoch"))
