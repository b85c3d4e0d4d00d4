"""Queries that score predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaframe.functions import arrays as A
from vistaframe.functions import text as T
from vistaframe.functions.slots import stub_embedding
from vistaframe.operators import metrics as M
from vistaframe.plans.catalogue import Catalogue
from vistaframe.sources.tables import table
from vistaframe.streaming.incremental import merge_results, windowed_counts

catalogue = Catalogue()
COLUMNS = ["Question_Id", "Question_Type", "Answers", "Model_Answer", "model_name"]


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "prediction", COLUMNS)


def _match():
    return M.matches(F.col("Model_Answer"), F.col("Answers"))


#: Letters, marks, digits and joiners of words, and white space, as classes of the SQL's patterns.
_W = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
_S = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def _stripped(c: str) -> str:
    return f"lower(regexp_replace({c}, '^[{_S}]+|[{_S}]+$', '', 'g'))"


def _set(c: str) -> str:
    return rf"list_sort(list_distinct(list_filter(string_split_regex(lower({c}), '\s+'), lambda t: t <> '')))"


_MATCHED = f"WITH p AS (SELECT *, coalesce(({_set('Model_Answer')} = {_set('Answers')})::INT, 0) AS m FROM prediction)"


@catalogue("token_set_accuracy", _MATCHED + " SELECT count(*) AS n, sum(m)::BIGINT AS matched, round(avg(m), 9) AS accuracy FROM p")
def token_set_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return M.accuracy(_predictions(spark, folder), [], _match()).select("n", "matched", F.round("accuracy", 9).alias("accuracy"))


@catalogue("category_accuracy", _MATCHED + " SELECT Question_Type, count(*) AS n, sum(m)::BIGINT AS matched, round(avg(m), 9) AS accuracy FROM p WHERE Question_Type IS NOT NULL GROUP BY 1")
def category_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """By question type, ascending by accuracy."""
    per = M.accuracy(_predictions(spark, folder).where(F.col("Question_Type").isNotNull()), ["Question_Type"], _match())
    return per.select("Question_Type", "n", "matched", F.round("accuracy", 9).alias("accuracy")).orderBy("accuracy", "Question_Type")


@catalogue("reaggregate", _MATCHED + " SELECT model_name, count(*) AS n, round(avg(m), 9) AS accuracy FROM p WHERE Question_Type IS NOT NULL GROUP BY 1")
def reaggregate(spark: SparkSession, folder: str) -> DataFrame:
    """Overall accuracy of each model from the accuracies of its categories."""
    per = M.accuracy(_predictions(spark, folder).where(F.col("Question_Type").isNotNull()), ["model_name", "Question_Type"], _match())
    return M.overall(per, ["model_name"]).select("model_name", "n", F.round("accuracy", 9).alias("accuracy"))


@catalogue("exact_match", f"SELECT model_name, count(*) AS total, sum(({_stripped('Model_Answer')} IS NOT DISTINCT FROM {_stripped('Answers')} AND Answers IS NOT NULL)::INT)::BIGINT AS matched FROM prediction GROUP BY 1")
def exact_match(spark: SparkSession, folder: str) -> DataFrame:
    hit = F.coalesce((F.lower(T.strip(F.col("Model_Answer"))) == F.lower(T.strip(F.col("Answers")))).cast("int"), F.lit(0))
    return _predictions(spark, folder).groupBy("model_name").agg(F.count("*").alias("total"), F.sum(hit).cast("long").alias("matched"))


def _vector(c: str) -> str:
    """The stub's vector of a normalised text: eight parts of its md5."""
    text = f"regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^{_W}{_S}]', '', 'g'), '[{_S}]+', ' ', 'g'), '^ | $', '', 'g')"
    return f"list_transform(range(0, 8), lambda i: ('0x' || substr(md5({text}), i * 4 + 1, 4))::BIGINT::DOUBLE / 65535)"


_ALIKE = f"WITH v AS (SELECT *, {_vector('Model_Answer')} AS v, {_vector('Answers')} AS w FROM prediction WHERE Question_Type IS NOT NULL), p AS (SELECT *, coalesce(({_set('Model_Answer')} = {_set('Answers')})::INT, 0) AS m, coalesce(list_sum(list_transform(range(1, 9), lambda i: v[i] * w[i])) / nullif(sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(w, lambda x: x * x))), 0), 0) AS s FROM v)"


def _similarity():
    return A.cosine(stub_embedding(T.normalized_answer(F.col("Model_Answer"))), stub_embedding(T.normalized_answer(F.col("Answers"))))


@catalogue("scored_files", _ALIKE + """, c AS (SELECT model_name AS file, Question_Type, count(*) AS n, avg(m) AS a, avg(s) AS s FROM p GROUP BY 1, 2)
SELECT file, round(sum(a * n) / sum(n), 9) AS simple_accuracy, round(sum(s * n) / sum(n), 6) AS neural_similarity, string_agg(Question_Type || '=' || round(a, 6)::DECIMAL(9, 6), ', ' ORDER BY Question_Type) AS per_category FROM c GROUP BY file""")
def scored_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each model's predictions as one file: overall and per-category accuracy, and similarity by the stub of the vectors."""
    m = _match()
    rows = M.scored_files(_predictions(spark, folder).withColumnRenamed("model_name", "file"), "file", "Question_Type", m, _similarity())
    cells = F.transform(F.array_sort(F.map_entries("Simple_Accuracy_Per_Category")), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 6).cast("decimal(9,6)").cast("string")))
    return rows.select("file", F.round("Simple_Accuracy", 9).alias("simple_accuracy"), F.round("Neural_Similarity", 6).alias("neural_similarity"), F.array_join(cells, ", ").alias("per_category"))


@catalogue("incremental_results", _MATCHED + """
SELECT model_name AS File_Name, round(avg(m), 9) AS accuracy FROM p WHERE model_name <> 'rgb7b' GROUP BY 1 UNION ALL SELECT 'rgb7b', -1.0""")
def incremental_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results of new files added to those scored before, which stay as they are."""
    done = spark.createDataFrame([("rgb7b", -1.0)], "File_Name string, accuracy double")
    fresh = M.accuracy(_predictions(spark, folder), ["model_name"], _match()).select(F.col("model_name").alias("File_Name"), F.round("accuracy", 9).alias("accuracy"))
    return merge_results(done, fresh)


@catalogue("random_baseline", """
WITH q AS (SELECT DISTINCT Question_Id, Question_Type, Answers FROM val_dataset WHERE Question_Type IS NOT NULL),
a AS (SELECT Question_Type, Answers, row_number() OVER (PARTITION BY Question_Type ORDER BY Answers) - 1 AS at_, count(*) OVER (PARTITION BY Question_Type) AS k FROM (SELECT DISTINCT Question_Type, Answers FROM q WHERE Answers IS NOT NULL)),
s AS (SELECT Question_Type, any_value(k) AS k FROM a GROUP BY 1),
h AS (SELECT q.Question_Type, s.k, coalesce((('0x' || substr(md5(Question_Id || '|42'), 1, 8))::BIGINT % s.k = a.at_)::INT, 0) AS hit FROM q JOIN s USING (Question_Type) LEFT JOIN a ON a.Question_Type = q.Question_Type AND a.Answers = q.Answers)
SELECT Question_Type, count(*) AS n, sum(hit)::BIGINT AS n_correct, round(avg(hit), 9) AS accuracy, round(100.0 / any_value(k), 9) AS expected_percent FROM h GROUP BY 1""")
def random_baseline(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "val_dataset", ["Question_Id", "Question_Type", "Answers"]).distinct()
    r = M.random_baseline(rows, "Question_Type", "Answers", "Question_Id")
    return r.select("Question_Type", "n", "n_correct", F.round("accuracy", 9).alias("accuracy"), F.round("expected_percent", 9).alias("expected_percent"))


@catalogue("mean_interval", """
SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(avg(value) - 1.959963984540054 * stddev_samp(value) / sqrt(count(value)), 6) AS low,
       round(avg(value) + 1.959963984540054 * stddev_samp(value) / sqrt(count(value)), 6) AS high FROM events GROUP BY 1""")
def mean_interval(spark: SparkSession, folder: str) -> DataFrame:
    r = M.mean_interval(table(spark, folder, "events", ["event_type", "value"]), ["event_type"], F.col("value"))
    return r.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@catalogue("proportion_interval", """
SELECT Question_Type, count(*) AS n, round(avg((Answers IS NULL)::INT), 6) AS p,
  round(greatest(0.0, avg((Answers IS NULL)::INT) - 1.959963984540054 * sqrt(avg((Answers IS NULL)::INT) * (1 - avg((Answers IS NULL)::INT)) / count(*))), 6) + 0.0 AS low,
  round(least(1.0, avg((Answers IS NULL)::INT) + 1.959963984540054 * sqrt(avg((Answers IS NULL)::INT) * (1 - avg((Answers IS NULL)::INT)) / count(*))), 6) AS high
FROM (SELECT DISTINCT Question_Id, Question_Type, Answers FROM train_dataset) GROUP BY 1""")
def proportion_interval(spark: SparkSession, folder: str) -> DataFrame:
    """Share of questions without an answer, by type."""
    rows = table(spark, folder, "train_dataset", ["Question_Id", "Question_Type", "Answers"]).distinct()
    r = M.proportion_interval(rows, ["Question_Type"], F.col("Answers").isNull())
    return r.select("Question_Type", "n", F.round("p", 6).alias("p"), (F.round("low", 6) + 0.0).alias("low"), F.round("high", 6).alias("high"))


@catalogue("score_stats", """
SELECT label, round(avg(embedding[1]::DOUBLE), 6) + 0.0 AS precision_mean, round(stddev_samp(embedding[1]::DOUBLE), 6) AS precision_std, round(avg(embedding[2]::DOUBLE), 6) + 0.0 AS recall_mean,
       round(stddev_samp(embedding[2]::DOUBLE), 6) AS recall_std, round(avg(embedding[3]::DOUBLE), 6) + 0.0 AS f1_mean, round(stddev_samp(embedding[3]::DOUBLE), 6) AS f1_std FROM embeddings GROUP BY 1""")
def score_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and sample deviation of three scores: the first coordinates stand for precision, recall and F1."""
    rows = table(spark, folder, "embeddings", ["label", "embedding"])
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    cols = [f for i, c in enumerate(("precision", "recall", "f1")) for f in ((F.round(F.avg(at(i)), 6) + 0.0).alias(f"{c}_mean"), F.round(F.stddev_samp(at(i)), 6).alias(f"{c}_std"))]
    return rows.groupBy("label").agg(*cols)


@catalogue("epoch_means", "SELECT date_trunc('day', ts) AS epoch, round(avg(value), 6) AS loss, count(*) AS n FROM events GROUP BY 1")
def epoch_means(spark: SparkSession, folder: str) -> DataFrame:
    """Mean loss by epoch: days as epochs."""
    rows = table(spark, folder, "events", ["ts", "value"])
    return rows.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"), F.count("*").alias("n"))


@catalogue("windowed_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events by hour and kind, by the function that streams use (an extension: the reference has no streams)."""
    rows = table(spark, folder, "events", ["ts", "event_type"]).withColumn("at", F.col("ts").cast("timestamp"))
    return windowed_counts(rows, "at", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@catalogue("answer_similarity", _ALIKE + " SELECT Question_Type, count(*) AS n, round(avg(s), 6) AS similarity FROM p GROUP BY 1")
def answer_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Mean similarity of predictions and answers by type, with the stub of the document vectors."""
    rows = _predictions(spark, folder).where(F.col("Question_Type").isNotNull())
    return rows.groupBy("Question_Type").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(_similarity(), F.lit(0.0))), 6).alias("similarity"))
