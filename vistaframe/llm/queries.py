"""Queries of this package and, where SQL can say the same over whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaframe.llm import bpe, canonical, overlap, packing, proportions, residue, terms
from vistaframe.operators.nested import object_names
from vistaframe.sources.tables import table

#: Literals that stand for a missing answer, exactly so written. Fixed values.
MISSING = ("None", "n/a", "null", "NA", "nan")
QA = ["Question_Id", "Questions", "Image_Path"]


def _typed(spark: SparkSession, folder: str) -> tuple[DataFrame, canonical.Mapper]:
    """(src, record_id, object_idx, kind, value) of every typed value that is not an item as it stands, and the mapper."""
    mapper = canonical.read_mapper(table(spark, folder, "canonical_item"), table(spark, folder, "combined_word_map"))
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    names = object_names(table(spark, folder, "annotation", ["annotation_id", "doc"]))
    names = names.select(F.lit("annotation").alias("src"), F.col("annotation_id").alias("record_id"), F.col("object_idx").cast("long").alias("object_idx"), F.lit("object").alias("kind"), F.col("name").alias("value"))
    val = table(spark, folder, "val_dataset", ["Question_Id", "Question_Type", "Answers"]).where(F.col("Answers").isNotNull() & ~F.col("Answers").isin(list(MISSING)))
    kind = F.when(F.col("Question_Type").isin("Object Identification", "Proximity"), "object").when(F.col("Question_Type") == "Color Identification", "color")
    answers = val.select(F.lit("val_dataset").alias("src"), F.col("Question_Id").alias("record_id"), F.lit(-1).cast("long").alias("object_idx"), kind.alias("kind"), F.col("Answers").alias("value"))
    return canonical.not_exact(names.unionAll(answers.where(F.col("kind").isNotNull())), mapper), mapper


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    typed, mapper = _typed(spark, folder)
    return canonical.map_values(typed, mapper).select("src", "record_id", "object_idx", "item_id").distinct()


def p1_stages(spark: SparkSession, folder: str) -> DataFrame:
    """How many values each stage has decided."""
    typed, mapper = _typed(spark, folder)
    mapped = canonical.map_values(typed, mapper).select("src", "record_id", "object_idx", "kind", "stage").distinct()
    return mapped.groupBy("src", "kind", "stage").agg(F.count("*").alias("n"))


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Typed values that stand for no item, and in how many records."""
    typed, mapper = _typed(spark, folder)
    none = canonical.map_values(typed, mapper).where(F.col("item_id") == 0).distinct()
    return none.groupBy("src", "kind", "value").agg(F.count("*").alias("n"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Categories to which calibration gives less than their need."""
    return _plan(spark, folder).report().where("gap > 0").select("category_id")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return _plan(spark, folder).report()


def p3_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _plan(spark, folder).sample()


def _plan(spark: SparkSession, folder: str) -> proportions.Plan:
    return proportions.Plan(table(spark, folder, "val_dataset", ["Question_Id", "Question_Type", "Answers"]), table(spark, folder, "sample_target"), missing=MISSING)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    evals = table(spark, folder, "val_dataset", QA).unionAll(table(spark, folder, "test_dataset", QA))
    pairs = overlap.overlapping_pairs(table(spark, folder, "train_dataset", QA), evals)
    return pairs.select(F.col("train_id").alias("train_question_id"), F.col("eval_id").alias("eval_question_id"))


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    evals = {"validation": table(spark, folder, "val_dataset", QA), "test": table(spark, folder, "test_dataset", QA)}
    return overlap.overlap_counts(table(spark, folder, "train_dataset", QA), evals)


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    names = terms.names_of(table(spark, folder, "annotation", ["annotation_id", "doc"]))
    answers = terms.values_of(table(spark, folder, "val_dataset", ["Question_Id", "Answers"]), "val_dataset.Answers", "Question_Id", "Answers", MISSING)
    return terms.marked_terms(terms.term_counts([names, answers]))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).where(F.col("mark").isNotNull()).select("field", "unit", "term", "mark")


def p5_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents", ["doc_id", "text"]))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = bpe.token_counts(table(spark, folder, "documents", ["doc_id", "text"]))
    return packing.containers(sizes, table(spark, folder, "context_window"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """For each window, the containers of harmonic packing alone and after the top-up, and the fewest that could do."""
    sizes = bpe.token_counts(table(spark, folder, "documents", ["doc_id", "text"]))
    return packing.fill(sizes, table(spark, folder, "context_window"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "documents", ["doc_id", "text", "source"]))


def p8_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return residue.found(table(spark, folder, "documents", ["doc_id", "text", "source"]))


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that are no case, without their texts."""
    return residue.without_residue(table(spark, folder, "documents", ["doc_id", "text", "source"])).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (p1_found, p1_stages, p1_unmatched, p3_found, p3_report, p3_sample, p4_found, p4_counts, p5_found, p5_terms, p6_ids, p7_containers, p7_fill, p8_found, p8_reasons, p8_kept)
    }


_MISSING = "'None', 'n/a', 'null', 'NA', 'nan'"

_P3 = f"""
WITH v AS (
  SELECT Question_Id, any_value(Question_Type) AS t,
         any_value(CASE WHEN Answers NOT IN ({_MISSING}) THEN lower(trim(Answers)) END) AS a
  FROM val_dataset GROUP BY Question_Id
), n AS (SELECT count(*) // 5 AS n FROM v),
c AS (
  SELECT coalesce(s.category_id, d.category_id) AS category_id, count(*) AS available
  FROM v LEFT JOIN sample_target s ON s.question_type = v.t AND lower(trim(s.answer)) = v.a
         LEFT JOIN sample_target d ON d.question_type = v.t AND d.answer IS NULL
  GROUP BY 1
), r AS (
  SELECT t.category_id, t.question_type, t.target_permille, n.n, greatest(t.target_permille * n.n // 1000, t.min_rows)::BIGINT AS need, coalesce(c.available, 0)::BIGINT AS available
  FROM sample_target t CROSS JOIN n LEFT JOIN c ON c.category_id = t.category_id
)"""

#: The expected counts by bisection: s shares the sample out to the types, w the type's part to its categories, by their shares.
_P3_REPORT = _P3.replace("WITH v AS", "WITH RECURSIVE v AS", 1) + """
, k AS (
  SELECT question_type AS t, sum(target_permille)::DOUBLE AS share, sum(least(need, available))::DOUBLE AS lo,
         sum(CASE WHEN target_permille > 0 THEN available ELSE least(need, available) END)::DOUBLE AS hi, any_value(n)::DOUBLE AS n FROM r GROUP BY 1
), g AS (SELECT least(greatest(any_value(n), sum(lo)), sum(hi)) AS goal, max(CASE WHEN share > 0 THEN hi / share ELSE 0 END) AS most FROM k),
s AS (
  SELECT 0 AS i, 0::DOUBLE AS lo, most AS hi FROM g
  UNION ALL
  SELECT i + 1, CASE WHEN f < goal THEN (lo + hi) / 2 ELSE lo END, CASE WHEN f < goal THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT s.i, s.lo, s.hi, g.goal, sum(greatest(k.lo, least(k.hi, k.share * (s.lo + s.hi) / 2))) AS f FROM s CROSS JOIN g CROSS JOIN k WHERE s.i < 100 GROUP BY ALL)
), m AS (SELECT t, greatest(k.lo, least(k.hi, k.share * s.hi)) AS margin FROM k CROSS JOIN s WHERE s.i = 100),
w AS (
  SELECT m.t, 0 AS i, 0::DOUBLE AS lo, max(CASE WHEN r.target_permille > 0 THEN r.available / r.target_permille ELSE 0 END)::DOUBLE AS hi
  FROM m JOIN r ON r.question_type = m.t GROUP BY m.t
  UNION ALL
  SELECT t, i + 1, CASE WHEN f < margin THEN (lo + hi) / 2 ELSE lo END, CASE WHEN f < margin THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT w.t, w.i, w.lo, w.hi, m.margin, sum(greatest(least(r.need, r.available), least(r.available, r.target_permille * (w.lo + w.hi) / 2))) AS f
        FROM w JOIN m USING (t) JOIN r ON r.question_type = w.t WHERE w.i < 100 GROUP BY ALL)
), e AS (
  SELECT r.*, round(greatest(least(r.need, r.available), least(r.available, r.target_permille * w.hi)), 6) AS exact FROM r JOIN w ON w.t = r.question_type AND w.i = 100
), o AS (
  SELECT *, row_number() OVER (ORDER BY round(exact - floor(exact), 6) DESC, category_id) AS place,
         round(sum(exact) OVER ())::BIGINT - sum(floor(exact)) OVER () AS spare FROM e
), d AS (SELECT *, (floor(exact) + CASE WHEN place <= spare THEN 1 ELSE 0 END)::BIGINT AS drawn FROM o)
SELECT category_id, need, available, round(exact, 4) AS expected, drawn, target_permille::DOUBLE / 1000 AS target_share,
       round(drawn::DOUBLE / greatest(1, sum(drawn) OVER ()), 6) AS share, round(greatest(need - exact, 0), 4) AS gap, round(greatest(need - exact, 0), 4) > 0 AS short FROM d
"""

_P5 = rf"""
WITH docs AS (SELECT annotation_id, any_value(doc) AS doc FROM annotation GROUP BY annotation_id),
ok AS (
  SELECT annotation_id, json_extract(doc, '$.objects') AS o FROM docs
  WHERE json_valid(doc) AND json_type(doc) = 'OBJECT' AND NOT regexp_matches(doc, ',\s*[\]}}]')
), names AS (
  SELECT 'annotation.name' AS field, annotation_id AS rec, unnest(json_extract(o, '$[*]')) AS e FROM ok WHERE json_type(o) = 'ARRAY'
), vals AS (
  SELECT field, rec, lower(trim(json_extract_string(e, '$.name'))) AS v FROM names
  WHERE json_type(e) = 'OBJECT' AND json_type(e, '$.name') = 'VARCHAR'
  UNION ALL
  SELECT 'val_dataset.Answers', Question_Id, lower(trim(any_value(Answers))) FROM val_dataset
  WHERE Answers IS NOT NULL AND Answers NOT IN ({_MISSING}) GROUP BY Question_Id
), kept AS (SELECT * FROM vals WHERE v <> ''),
terms AS (
  SELECT field, rec, 'value' AS unit, v AS term FROM kept
  UNION ALL SELECT field, rec, 'word', unnest(regexp_extract_all(v, '[\p{{L}}\p{{N}}]+')) FROM kept
), totals AS (SELECT field, count(DISTINCT rec) AS total FROM kept GROUP BY field),
counted AS (SELECT field, unit, term, count(*) AS occurrences, count(DISTINCT rec) AS records FROM terms GROUP BY ALL),
marked AS (
  SELECT field, unit, term, occurrences, records,
         CASE WHEN records < 3 THEN 'rare' WHEN records * 20 > total THEN 'common' END AS mark
  FROM counted JOIN totals USING (field)
)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _P3 + " SELECT category_id FROM r WHERE available < need",
        "p3_report": _P3_REPORT,
        "p5_found": _P5 + " SELECT field, unit, term, mark FROM marked WHERE mark IS NOT NULL",
        "p5_terms": _P5 + " SELECT field, unit, term, occurrences, records, mark FROM marked",
    }
