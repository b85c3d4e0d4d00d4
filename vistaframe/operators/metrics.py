"""Scores of predictions. Every roll-up is one aggregation with partial sums in the map tasks."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaframe.functions.arrays import same_set
from vistaframe.functions.numbers import tokens
from vistaframe.operators.ranking import sequential_ids


def lemmas(text: Column) -> Column:
    """Default slot of the lemmatizer: lower-case tokens."""
    return tokens(F.lower(text))


def matches(prediction: Column, reference: Column, normal=lemmas) -> Column:
    """1 if both have the same set of tokens, else 0; 0 if either is NULL."""
    return F.coalesce(same_set(normal(prediction), normal(reference)).cast("int"), F.lit(0))


def accuracy(df: DataFrame, by: list[str], match: Column) -> DataFrame:
    """(by, n, matched, accuracy), ascending by accuracy when shown; 0.0 without rows."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(match).cast("long").alias("matched"), F.coalesce(F.avg(match), F.lit(0.0)).alias("accuracy"))


def overall(per_category: DataFrame, by: list[str]) -> DataFrame:
    """Overall accuracy from accuracies of categories, weighted by their counts."""
    weighted = F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")
    return per_category.groupBy(*by).agg(F.sum("n").alias("n"), weighted.alias("accuracy"))


def mean_interval(df: DataFrame, by: list[str], value: Column, level: float = 0.95) -> DataFrame:
    """(by, n, mean, low, high) of a normal interval; NULL bounds for a single row."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    stats = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    margin = F.lit(z) * F.col("sd") / F.sqrt("n")
    return stats.select(*by, "n", "mean", (F.col("mean") - margin).alias("low"), (F.col("mean") + margin).alias("high"))


def proportion_interval(df: DataFrame, by: list[str], hit: Column, level: float = 0.95) -> DataFrame:
    """(by, n, p, low, high) of a proportion, the bounds kept within 0 and 1."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    stats = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("p"))
    margin = F.lit(z) * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return stats.select(*by, "n", "p", F.greatest(F.lit(0.0), F.col("p") - margin).alias("low"), F.least(F.lit(1.0), F.col("p") + margin).alias("high"))


def random_baseline(df: DataFrame, kind: str, answer: str, key: str, seed: int = 42) -> DataFrame:
    """(kind, n, n_correct, accuracy, expected_percent): each row is answered with one of its kind's distinct answers.

    The answers of a kind are numbered in sorted order, without a window of one kind; a row draws a number by md5, and is
    right if that is its answer's. Rows are counted by kind, answer and draw in the map tasks before they are joined, so an
    answer that fills a kind is a row for each number. Kinds (``MAX_KINDS`` at most, checked) are broadcast."""
    answers = df.where(F.col(answer).isNotNull() & F.col(kind).isNotNull()).select(kind, answer).distinct()
    numbered = sequential_ids(answers, [kind, answer], "_id", 0)
    sizes = numbered.groupBy(kind).agg(F.count("*").alias("_n"), F.min("_id").alias("_start")).limit(MAX_KINDS + 1).collect()
    if len(sizes) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds")
    known = F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in sizes], f"`{kind}` string, _n long, _start long"))
    digits = F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8)
    drawn = F.pmod(F.conv(digits, 16, 10).cast("long"), F.col("_n"))
    counted = df.join(known, kind).withColumn("_drawn", drawn).groupBy(kind, answer, "_drawn").agg(F.count("*").alias("_rows"))
    placed = numbered.join(known, kind).select(kind, answer, (F.col("_id") - F.col("_start")).alias("_at"))
    hit = F.coalesce((F.col("_drawn") == F.col("_at")).cast("long"), F.lit(0)) * F.col("_rows")
    stats = counted.join(placed, [kind, answer], "left").groupBy(kind).agg(F.sum("_rows").alias("n"), F.sum(hit).alias("n_correct"))
    return stats.join(known, kind).select(kind, "n", "n_correct", (F.col("n_correct") / F.col("n")).alias("accuracy"), (100.0 / F.col("_n")).alias("expected_percent"))


#: Proven bound of the number of kinds of questions.
MAX_KINDS = 10_000


def scored_files(df: DataFrame, file: str, kind: str, match: Column, similarity: Column) -> DataFrame:
    """A row for each file: overall and per-category accuracy and similarity, the overall figures from the categories'."""
    rows = df.where(F.col(kind).isNotNull())
    per = rows.groupBy(file, kind).agg(F.count("*").alias("n"), F.avg(match).alias("a"), F.avg(F.coalesce(similarity, F.lit(0.0))).alias("s"))
    cells = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, c))))
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    return per.groupBy(file).agg(
        mean("a").alias("Simple_Accuracy"), cells("a").alias("Simple_Accuracy_Per_Category"), mean("s").alias("Neural_Similarity"), cells("s").alias("Neural_Similarity_Per_Category")
    ).orderBy(file)
