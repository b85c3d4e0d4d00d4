"""Question-answer tables: union, repair, filters, balance, samples, splits.

Pseudo-random orders are those of md5(key, seed), so that they are the same on every cluster and in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaframe.functions import text as T
from vistaframe.operators.ranking import capped, sequential_ids
from vistaframe.session import cut

REQUIRED = ("Questions", "Answers", "Image_Path", "Depth_Path", "Question_Type")


def union_required(frames: Sequence[DataFrame], required: Sequence[str] = REQUIRED) -> DataFrame:
    """Union by name of the frames that have all required columns; others are left out; missing further columns are NULL."""
    kept = [df for df in frames if set(required) <= set(df.columns)]
    if not kept:
        raise ValueError("no frame has the required columns")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept)


def random_key(*columns: Column | str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns], F.lit(str(seed))))


def repaired(df: DataFrame, question: str = "Questions", answer: str = "Answers") -> DataFrame:
    return df.withColumns({question: T.repaired(F.col(question), T.QUESTION_REPAIRS), answer: T.repaired(T.gray(F.col(answer)), T.ANSWER_REPAIRS)})


def without_noise(df: DataFrame, question: str = "Questions", answer: str = "Answers") -> DataFrame:
    return df.where(~(T.is_noise(F.col(question)) | T.is_noise(F.col(answer))))


def balance_by_type(df: DataFrame, image: str = "Image_Path", kind: str = "Question_Type", order: str = "Question_Id") -> DataFrame:
    """Each type keeps the rows of its own chunk of images: k = images div types, chunk i of the sorted images goes to the
    i-th type by first appearance; images left over go to none.

    The images are numbered without a global window; the types (``MAX_TYPES`` at most, checked) are broadcast."""
    kinds = df.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.min(order).alias("_at")).orderBy("_at", kind).limit(MAX_TYPES + 1).collect()
    if len(kinds) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} types")
    images = sequential_ids(df.where(F.col(image).isNotNull()).select(F.col(image).alias("_image")).distinct(), ["_image"], "_rank", first=0)
    n = images.count()
    k = n // len(kinds) if kinds else 0
    if not k:
        return df.limit(0)
    ranks = F.broadcast(df.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(kinds)], f"`{kind}` string, _chunk long"))
    chunks = images.select("_image", F.floor(F.col("_rank") / k).alias("_chunk"))
    typed = df.join(ranks, kind)
    return typed.join(chunks, (typed[image] == chunks["_image"]) & (typed["_chunk"] == chunks["_chunk"])).select(*df.columns)


#: Rows up to which the first by an order are taken from each task; beyond, the rows are sorted and numbered.
TOP_ROWS = 10_000
#: Proven bound of the number of question types.
MAX_TYPES = 10_000


def pick(df: DataFrame, k: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """k rows in the order of md5, all if there are fewer. key: a unique key."""
    keyed = df.withColumn("_key", random_key(*key, seed=seed))
    if k <= TOP_ROWS:  # each task keeps its first k, and only those are brought together
        return keyed.orderBy("_key", *key).limit(max(k, 0)).drop("_key")
    return sequential_ids(keyed, ["_key", *key], "_rn").where(F.col("_rn") <= k).drop("_rn", "_key")


def balance_yes_no(df: DataFrame, kind: str = "Question_Type", answer: str = "Answers", key: Sequence[str] = ("Question_Id",), seed: int = 42) -> DataFrame:
    """target = rows of Yes/No div 2; target div 2 of yes and of no stay, the other types as they are (NULL types too)."""
    is_kind = F.col(kind).eqNullSafe("Yes/No")
    target = df.where(is_kind).count() // 2
    said = F.lower(F.col(answer))
    yes = pick(df.where(is_kind & (said == "yes")), target // 2, key, seed)
    no = pick(df.where(is_kind & (said == "no")), target // 2, key, seed)
    return df.where(~is_kind).unionByName(yes).unionByName(no)


def split_721(df: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """df with ``split`` (70, 20 and 10 percent by the order of md5) and an id from 1 within it. The bounds are products
    of doubles, cut, as in the reference."""
    keyed = df.withColumn("_key", random_key(*key, seed=seed))
    numbered = sequential_ids(keyed, ["_key", *key], "_rn")
    n = df.count()
    a, b = int(0.7 * n), int(0.9 * n)
    split = F.when(F.col("_rn") <= a, "train").when(F.col("_rn") <= b, "test").otherwise("validation")
    start = F.when(F.col("_rn") <= a, 0).when(F.col("_rn") <= b, a).otherwise(b)
    return numbered.withColumn("split", split).withColumn("id_in_split", (F.col("_rn") - start).cast("long")).drop("_rn", "_key")


def curated(frames: Sequence[DataFrame], balance: bool = True, key: str = "Question_Id", seed: int = 42) -> DataFrame:
    """Union, repair, filter, balance (not for training splits) and new ids from 1."""
    rows = without_noise(repaired(union_required(frames)))
    if balance:
        rows = balance_yes_no(balance_by_type(cut(rows, "curated"), order=key), key=(key,), seed=seed)
    return sequential_ids(rows.withColumnRenamed(key, "_key"), ["_key"], key).drop("_key")


def without_objects(df: DataFrame, scene: str, obj: str, unwanted: DataFrame) -> DataFrame:
    """Objects or polygons without those of the unwanted (scene, object) ids; the ids of the others stay as they are."""
    return df.join(unwanted.select(scene, obj).distinct(), [scene, obj], "left_anti")


def with_files(df: DataFrame, listing: DataFrame, column: str, path: str = "path") -> DataFrame:
    """Rows whose file is not NULL and is in the listing."""
    return df.where(F.col(column).isNotNull()).join(listing.select(F.col(path).alias(column)).distinct(), column, "left_semi")


def zipped(predictions: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Predictions with their references by key; an error if there are not as many of the one as of the other."""
    a, b = predictions.count(), references.count()
    if a != b:
        raise ValueError(f"{a} predictions and {b} references")
    return predictions.join(references, key)


def capped_names(df: DataFrame, name: str, order: str, caps: dict[str, int] | None = None) -> DataFrame:
    """At most so many rows of each named object. The reference's caps never take effect, so there are none by default."""
    out = df
    for word, most in (caps or {}).items():
        hit = F.coalesce(F.lower(F.col(name)) == word, F.lit(False))
        out = out.where(~hit).unionByName(capped(out.where(hit), [name], [order], most))
    return out


def keys_of(pairs: Column, value: Column) -> Column:
    """Keys of a map that hold a value."""
    return F.map_keys(F.map_filter(pairs, lambda _, v: v.eqNullSafe(value)))


def casefold_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.lower(F.col(column).cast("string")).alias(column)).distinct()


def unordered_pairs(df: DataFrame, a: str, b: str, order: str | None = None) -> DataFrame:
    """(a, b) of each pair once, whichever way round; with order as the first row has it, else the lesser first."""
    low, high = F.least(a, b), F.greatest(a, b)
    if order is None:
        return df.select(low.alias("a"), high.alias("b")).distinct()
    first = F.min_by(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.col(order))
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(low.alias("_low"), high.alias("_high")).agg(first.alias("p")).select("p.a", "p.b")


def without_files(df: DataFrame, done: DataFrame, column: str = "File_Name") -> DataFrame:
    """Rows of files that aren't in done."""
    return df.join(done.select(column).distinct(), column, "left_anti")
