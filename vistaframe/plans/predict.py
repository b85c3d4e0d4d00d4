"""Predictions: questions and pictures through a model's slot to the table that is scored."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaframe.functions import text as T
from vistaframe.operators.curation import with_files

COLUMNS = ("Question_Id", "Questions", "Question_Type", "Answers")


def echo_model(prompt: Column, rgb: Column, depth: Column) -> Column:
    """Stub of a model: its chat with a fixed answer."""
    return F.concat(F.lit("user "), prompt, F.lit(" assistant "), F.when(depth.isNull() & rgb.isNull(), "unknown").otherwise("2"))


def predicted(qa: DataFrame, model: Callable[[Column, Column, Column], Column] = echo_model, root: str = "/data", listing: DataFrame | None = None, suffix: str = T.SUFFIX_ONE_WORD, post=T.after_marker) -> DataFrame:
    """(Question_Id, Questions, Question_Type, Answers, Model_Answer): one row for each question whose picture is there.

    model gives a text for the prompt and the two paths (``slots.arrow_slot`` makes one of a function over batches); post
    takes the answer out of it. Without a listing every row with a path is asked."""
    rows = with_files(qa, listing, "Image_Path") if listing is not None else qa.where(F.col("Image_Path").isNotNull())
    said = model(F.concat("Questions", F.lit(suffix)), T.image_path(root, F.col("Image_Path")), T.image_path(root, F.col("Depth_Path")))
    return rows.select(*COLUMNS, post(said).alias("Model_Answer")).withColumn("Answers", F.lower(T.strip(F.col("Answers"))))


def predicted_each(qa: DataFrame, encodings: Mapping[str, Callable[[Column], Column]], model: Callable[[Column, Column, Column], Column] = echo_model, root: str = "/data", suffix: str = T.SUFFIX_STRICT, post=T.after_marker) -> DataFrame:
    """As ``predicted``, with a row for each way to hand the depth picture over: encodings give, by name, what the model gets
    for its path. All are asked in one pass; a table for each is a filter on ``encoding``."""
    rows = qa.where(F.col("Image_Path").isNotNull())
    prompt, rgb, depth = F.concat("Questions", F.lit(suffix)), T.image_path(root, F.col("Image_Path")), T.image_path(root, F.col("Depth_Path"))
    said = F.array(*[F.struct(F.lit(name).alias("encoding"), model(prompt, rgb, encoded(depth)).alias("said")) for name, encoded in encodings.items()])
    return rows.select(*COLUMNS, F.inline(said)).select(*COLUMNS, "encoding", post(F.col("said")).alias("Model_Answer")).withColumn("Answers", F.lower(T.strip(F.col("Answers"))))


def exact_report(answers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, matched, accuracy) of predictions that equal their answer but for case and outer spaces."""
    hit = F.coalesce((F.lower(T.strip(F.col("Model_Answer"))) == F.lower(T.strip(F.col("Answers")))).cast("int"), F.lit(0))
    return answers.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(hit), F.lit(0)).alias("matched"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"))
