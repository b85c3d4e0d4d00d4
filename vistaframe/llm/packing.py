"""Filling fixed-capacity containers with texts sized in tokens.

Method: harmonic packing, then a top-up.

1. ``harmonic``: the class of a text is how many of its size a container holds, capacity div size; above ``classes`` the
   classes are thinned out, eight to each doubling, always downwards. Every class is cut into blocks by hash, and each block
   fills its own containers with exactly so many texts as its class says (its last one with fewer), independently of all
   others across the workers. This is a numbering, so it is plain SQL.
2. ``topped_up``: harmonic containers of classes of large texts keep up to half of their room. Containers of all classes are
   mixed by hash into blocks; in each, in the order of the classes, a container keeps what harmonic packing gave it and takes
   the largest texts that still fit from the containers behind it; those that lose all their texts vanish. ``fill`` reports
   the containers of both steps.

At scale: narrow (id, piece, size) rows are all that is shuffled, once by class and block and once by mixed block. The
numbers of blocks follow the corpus (``BLOCK_TEXTS``, ``BLOCK_CONTAINERS``), so a task's memory does not. The driver sees one
number for each window and class.

Defined cases
* null and empty texts: size 0, in the class of size 1.
* a text larger than the capacity: pieces of exactly the capacity, a container each, and its rest as a text; piece counts
  from 0. Other texts have the one piece 0.
* repeated ids: once (the largest size counts). A null id: one text. Ties of size: by id.
* no texts or no containers: no rows. A capacity below 1: an error. Columns besides those named: not read.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistaframe.session import cut

#: Classes that hold one number each; the larger numbers share classes, ``PER_DOUBLING`` to each doubling.
CLASSES, PER_DOUBLING = 16, 8
BLOCK_CONTAINERS, BLOCK_TEXTS = 512, 50_000
#: Proven bound of the table of containers, checked when it is read.
MAX_WINDOWS = 1000


def reciprocal_class(size: Column, capacity: Column, classes: int = CLASSES) -> Column:
    """How many texts of its class a container gets: never more than fit, whatever their sizes."""
    fits = F.floor(capacity / F.greatest(size, F.lit(1)))
    step = F.floor(F.log2(fits / F.lit(classes)) * PER_DOUBLING) / F.lit(PER_DOUBLING)
    return F.when(fits <= classes, fits).otherwise(F.least(fits, F.greatest(F.floor(F.lit(classes) * F.pow(F.lit(2.0), step)), F.lit(classes).cast("long"))))


def _windows(windows: DataFrame) -> list[tuple[int, int]]:
    listed = windows.select("window_id", "capacity_tokens").dropna().distinct().limit(MAX_WINDOWS + 1).collect()
    if len(listed) > MAX_WINDOWS:
        raise ValueError(f"more than {MAX_WINDOWS} containers")
    if any(r[1] < 1 for r in listed):
        raise ValueError("a capacity below 1")
    return sorted((int(w), int(c)) for w, c in listed)


def harmonic(sizes: DataFrame, windows: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", classes: int = CLASSES) -> DataFrame:
    """(window_id, capacity, class, block, bin, id, piece, size) of every text for every window (window_id, capacity_tokens):
    the container is (class, block, bin)."""
    spark, listed = sizes.sparkSession, _windows(windows)
    kind = sizes.schema[id_col].dataType.simpleString()
    if not listed:
        return spark.createDataFrame([], f"window_id bigint, capacity bigint, class bigint, block bigint, bin bigint, id {kind}, piece int, size bigint")
    plan = F.array(*[F.struct(F.lit(w).cast("long").alias("window_id"), F.lit(c).cast("long").alias("capacity")) for w, c in listed])
    once = sizes.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.greatest(F.max(F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0))), F.lit(0)).alias("whole"))
    each = cut(once, "sizes").select("id", "whole", F.inline(plan))
    full, rest = F.floor(F.col("whole") / F.col("capacity")), F.col("whole") % F.col("capacity")
    last = F.greatest(full - F.when(rest == 0, 1).otherwise(0), F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.struct(i.cast("int").alias("piece"), F.when(i < full, F.col("capacity")).otherwise(rest).alias("size")))
    each = each.select("window_id", "capacity", "id", F.inline(pieces))
    each = each.withColumn("class", reciprocal_class(F.col("size"), F.col("capacity"), classes))
    counted = each.groupBy("window_id", "class").agg(F.count("*").alias("n")).select("window_id", "class", F.ceil(F.col("n") / F.lit(BLOCK_TEXTS)).alias("blocks")).collect()
    if not counted:
        return each.select("window_id", "capacity", "class", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("bin"), "id", "piece", "size")
    # a row for each window and class in use: classes grow with the logarithm of the capacity
    blocks = F.broadcast(spark.createDataFrame([tuple(r) for r in counted], "window_id bigint, class bigint, blocks bigint"))
    each = each.join(blocks, ["window_id", "class"]).withColumn("block", F.pmod(F.xxhash64("id", "piece"), F.col("blocks")))
    place = F.row_number().over(Window.partitionBy("window_id", "class", "block").orderBy("id", "piece"))
    return each.select("window_id", "capacity", "class", "block", F.floor((place - 1) / F.col("class")).alias("bin"), "id", "piece", "size")


def top_up(bins: list[list[int]], capacity: int) -> list[int]:
    """The new container of each item, in the order of the bins, counted from 0 as they are opened. A bin keeps its items
    that no earlier one has taken, and takes the largest that fit from those behind it."""
    sizes = [s for b in bins for s in b]
    stock: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        stock.setdefault(s, []).append(i)
    left = {s: len(items) for s, items in stock.items()}
    kinds = sorted(stock)
    where = [-1] * len(sizes)

    def put(i: int, container: int) -> None:
        where[i] = container
        size = sizes[i]
        left[size] -= 1
        if not left[size]:
            del kinds[bisect_right(kinds, size) - 1]

    opened, start = 0, 0
    for items in bins:
        own = [i for i in range(start, start + len(items)) if where[i] < 0]
        start += len(items)
        if not own:
            continue
        for i in own:
            put(i, opened)
        room = capacity - sum(sizes[i] for i in own)
        while (at := bisect_right(kinds, room) - 1) >= 0:
            pile = stock[kinds[at]]
            while where[pile[-1]] >= 0:
                pile.pop()
            i = pile.pop()
            room -= sizes[i]
            put(i, opened)
        opened += 1
    return where


def topped_up(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(window_id, container_id, <id>, piece, n_tokens) from the containers of ``harmonic``."""
    kind = packed.schema["id"].dataType.simpleString()
    schema = f"window_id BIGINT, container_id BIGINT, `{id_col}` {kind}, piece INT, n_tokens BIGINT"
    totals = packed.groupBy("window_id").agg(F.max("capacity").alias("c"), F.sum("size").alias("tokens"), F.count("*").alias("n")).collect()
    if not totals:
        return packed.sparkSession.createDataFrame([], schema)
    mixes = [(r["window_id"], max(1, -(-r["tokens"] // (r["c"] * BLOCK_CONTAINERS)), -(-r["n"] // BLOCK_TEXTS))) for r in totals]
    mixed = packed.join(F.broadcast(packed.sparkSession.createDataFrame(mixes, "window_id bigint, mixes bigint")), "window_id")
    mixed = mixed.withColumn("mix", F.pmod(F.xxhash64("class", "block", "bin"), F.col("mixes"))).drop("mixes")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["class", "block", "bin", "size", "id", "piece"], ascending=[True, True, True, False, True, True], kind="stable")
        first = ~pdf.duplicated(["class", "block", "bin"]).to_numpy()
        ends = np.append(np.flatnonzero(first), len(pdf))
        sizes = pdf["size"].tolist()
        where = top_up([sizes[a:b] for a, b in zip(ends[:-1], ends[1:])], int(pdf["capacity"].iloc[0]))
        at = (int(pdf["mix"].iloc[0]) << 32) + np.array(where, dtype="int64")
        return pd.DataFrame({"window_id": pdf["window_id"].array, "container_id": at, id_col: pdf["id"].array, "piece": pdf["piece"].array, "n_tokens": pdf["size"].array})

    return mixed.groupBy("window_id", "mix").applyInPandas(run, schema)


def containers(sizes: DataFrame, windows: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", classes: int = CLASSES) -> DataFrame:
    """(window_id, container_id, <id>, piece, n_tokens): both steps. The harmonic containers are written once, between them."""
    return topped_up(cut(harmonic(sizes, windows, id_col, size_col, classes), "harmonic"), id_col)


def fill(sizes: DataFrame, windows: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", classes: int = CLASSES) -> DataFrame:
    """(window_id, harmonic, containers, tokens, least): containers of the first step alone and after the top-up, what they
    hold, and the fewest that could hold it."""
    first = cut(harmonic(sizes, windows, id_col, size_col, classes), "harmonic")
    pure = first.groupBy("window_id", "class", "block").agg((F.max("bin") + 1).alias("n")).groupBy("window_id").agg(F.sum("n").alias("harmonic"))
    per = topped_up(first, id_col).groupBy("window_id", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("window_id").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"))
    capacity = first.groupBy("window_id").agg(F.max("capacity").alias("capacity"))
    return per.join(pure, "window_id").join(capacity, "window_id").select("window_id", "harmonic", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"))
