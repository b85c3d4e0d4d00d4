"""Problem 2 on the project's tables: nested annotation documents to flat tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaframe.operators import nested
from vistaframe.session import scratch
from vistaframe.sources.tables import table


INDEX = ["annotation_id", "frame_idx", "polygon_idx", "child_idx"]


def _written(spark: SparkSession, folder: str) -> str:
    """Writes the tables of all documents, each once, partitioned by tag; the path."""
    path = scratch(spark, "parts")
    nested.write_tables(nested.once(table(spark, folder, "annotation", ["annotation_id", "doc"])), path)
    return path


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every part of every document, read from the five tables."""
    path = _written(spark, folder)
    return reduce(DataFrame.unionAll, [nested.read_table(spark, path, tag).select(F.lit(tag).alias("part_kind"), *INDEX) for tag in nested.TAGS])


def p2_links(spark: SparkSession, folder: str) -> DataFrame:
    """For each table its rows, those whose parent is there (points joined to polygons, polygons to frames, and polygons to the
    object they name), and sums of its payload."""
    path = _written(spark, folder)
    t = {tag: nested.read_table(spark, path, tag) for tag in nested.TAGS}
    up = lambda child, parent: child.join(parent.select(F.col("annotation_id"), F.col("own_key").alias("parent_key"), F.lit(1).alias("_up")), ["annotation_id", "parent_key"], "left")
    named = t["object"].select("annotation_id", F.col("child_idx"), F.col("name").alias("object_name"), F.lit(1).alias("_named"))
    polygons = up(t["polygon"], t["frame"]).join(named, ["annotation_id", "child_idx"], "left")
    n = lambda c: F.coalesce(F.sum(c.cast("double")), F.lit(0.0))

    def row(rows: DataFrame, tag: str, linked, first, second) -> DataFrame:
        return rows.agg(F.count("*").alias("n"), F.count(linked).alias("linked"), F.round(n(first), 3).alias("first_sum"), F.round(n(second), 3).alias("second_sum")).select(F.lit(tag).alias("part_kind"), "n", "linked", "first_sum", "second_sum")

    parts = [
        row(t["object"], "object", F.col("own_key"), F.length("name"), F.col("is_object").cast("int")),
        row(t["frame"], "frame", F.col("own_key"), F.col("n_polygons"), F.col("frame_idx")),
        row(polygons, "polygon", "_up", F.size("x") + F.size("y"), F.col("n_points")),
        row(polygons.where(F.col("_named").isNotNull()), "polygon of object", "_named", F.length("object_name"), F.col("child_idx")),
        row(up(t["point"], t["polygon"]), "point", "_up", F.round("x", 3) + F.round("y", 3), F.round("z", 3)),
        row(t["bad"], "bad", F.lit(None), F.col("n_chars"), F.lit(0)),
    ]
    return reduce(DataFrame.unionAll, parts)


def p2_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by part, and the sums of their indexes."""
    found = p2_found(spark, folder)
    return found.groupBy("part_kind").agg(
        F.count("*").alias("n"),
        F.countDistinct("annotation_id").alias("docs"),
        F.sum(F.col("frame_idx").cast("long")).alias("frame_sum"),
        F.sum(F.col("polygon_idx").cast("long")).alias("polygon_sum"),
        F.sum(F.col("child_idx").cast("long")).alias("child_sum"),
    )


P2 = r"""
WITH docs AS (SELECT annotation_id, any_value(doc) AS doc FROM annotation GROUP BY annotation_id),
ok AS (
  SELECT annotation_id, doc::JSON AS j FROM docs
  WHERE json_valid(doc) AND json_type(doc) = 'OBJECT' AND NOT regexp_matches(regexp_replace(doc, '"(\\.|[^"\\])*"', '""', 'g'), ',\s*[\]}]')
), sized AS (
  SELECT annotation_id, j, CASE WHEN json_type(j, '$.objects') = 'ARRAY' THEN json_array_length(j, '$.objects')::INT ELSE 0 END AS n_objects FROM ok
), f AS (
  SELECT annotation_id, n_objects, unnest(json_extract(j, '$.frames[*]')) AS f, unnest(range(json_array_length(j, '$.frames')::INT)) AS fi
  FROM sized WHERE json_type(j, '$.frames') = 'ARRAY'
), fo AS (SELECT * FROM f WHERE json_type(f) = 'OBJECT'),
p AS (
  SELECT annotation_id, n_objects, fi, unnest(json_extract(f, '$.polygon[*]')) AS p, unnest(range(json_array_length(f, '$.polygon')::INT)) AS pi
  FROM fo WHERE json_type(f, '$.polygon') = 'ARRAY'
), po AS (SELECT * FROM p WHERE json_type(p) = 'OBJECT'),
x AS (
  SELECT annotation_id, fi, pi, unnest(json_extract(p, '$.XYZ[*]')) AS x, unnest(range(json_array_length(p, '$.XYZ')::INT)) AS xi
  FROM po WHERE json_type(p, '$.XYZ') = 'ARRAY'
), found AS (
  SELECT 'object' AS part_kind, annotation_id, -1 AS frame_idx, -1 AS polygon_idx, unnest(range(n_objects))::INT AS child_idx FROM sized
  UNION ALL SELECT 'frame', annotation_id, fi::INT, -1, -1 FROM fo
  UNION ALL SELECT 'polygon', annotation_id, fi::INT, pi::INT,
    CASE WHEN json_type(p, '$.object') IN ('BIGINT', 'UBIGINT') AND json_extract(p, '$.object')::BIGINT BETWEEN 0 AND n_objects - 1
         THEN json_extract(p, '$.object')::INT ELSE -1 END FROM po
  UNION ALL SELECT 'point', annotation_id, fi::INT, pi::INT, xi::INT FROM x
    WHERE json_type(x) = 'ARRAY' AND json_type(x, '$[0]') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
      AND json_type(x, '$[1]') IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND json_type(x, '$[2]') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
  UNION ALL SELECT 'bad', annotation_id, -1, -1, -1 FROM docs WHERE annotation_id NOT IN (SELECT annotation_id FROM ok)
)"""

_NUMBER = "IN ('BIGINT', 'UBIGINT', 'DOUBLE')"
_N = lambda path: f"(CASE json_type(p, '{path}') WHEN 'ARRAY' THEN len(list_filter(json_extract(p, '{path}[*]'), lambda e: json_type(e) {_NUMBER})) ELSE CASE WHEN json_type(p, '{path}') {_NUMBER} THEN 1 ELSE 0 END END)"
P2_LINKS = P2 + f"""
, objects AS (SELECT annotation_id, unnest(json_extract(j, '$.objects[*]')) AS o, unnest(range(n_objects)) AS oi FROM sized WHERE n_objects > 0),
named AS (SELECT annotation_id, oi, json_type(o) = 'OBJECT' AS is_object, CASE WHEN json_type(o) = 'OBJECT' AND json_type(o, '$.name') = 'VARCHAR' THEN json_extract_string(o, '$.name') END AS name FROM objects),
ref AS (SELECT annotation_id, fi, pi, p, CASE WHEN json_type(p, '$.object') IN ('BIGINT', 'UBIGINT') AND json_extract(p, '$.object')::BIGINT BETWEEN 0 AND n_objects - 1 THEN json_extract(p, '$.object')::BIGINT END AS oi FROM po),
pt AS (SELECT * FROM x WHERE json_type(x) = 'ARRAY' AND json_type(x, '$[0]') {_NUMBER} AND json_type(x, '$[1]') {_NUMBER} AND json_type(x, '$[2]') {_NUMBER})
SELECT 'object' AS part_kind, count(*) AS n, count(*) AS linked, coalesce(sum(length(name)), 0)::DOUBLE AS first_sum, coalesce(sum(is_object::INT), 0)::DOUBLE AS second_sum FROM named
UNION ALL SELECT 'frame', count(*), count(*), coalesce(sum(CASE WHEN json_type(f, '$.polygon') = 'ARRAY' THEN json_array_length(f, '$.polygon')::BIGINT ELSE 0 END), 0)::DOUBLE, coalesce(sum(fi), 0)::DOUBLE FROM fo
UNION ALL SELECT 'polygon', count(*), count(*), coalesce(sum({_N('$.x')} + {_N('$.y')}), 0)::DOUBLE, coalesce(sum(CASE WHEN json_type(p, '$.XYZ') = 'ARRAY' THEN json_array_length(p, '$.XYZ')::BIGINT ELSE 0 END), 0)::DOUBLE FROM po
UNION ALL SELECT 'polygon of object', count(*), count(*), coalesce(sum(length(name)), 0)::DOUBLE, coalesce(sum(oi), 0)::DOUBLE FROM ref JOIN named USING (annotation_id, oi)
UNION ALL SELECT 'point', count(*), count(*), round(coalesce(sum(round((x->>0)::DOUBLE, 3) + round((x->>1)::DOUBLE, 3)), 0), 3), round(coalesce(sum(round((x->>2)::DOUBLE, 3)), 0), 3) FROM pt
UNION ALL SELECT 'bad', count(*), 0, coalesce(sum(length(doc)), 0)::DOUBLE, 0 FROM docs WHERE annotation_id NOT IN (SELECT annotation_id FROM ok)
"""

QUERIES = {"p2_found": p2_found, "p2_links": p2_links, "p2_parts": p2_parts}
ORACLE = {
    "p2_links": P2_LINKS,
    "p2_found": P2 + " SELECT part_kind, annotation_id, frame_idx, polygon_idx, child_idx FROM found",
    "p2_parts": P2
    + """ SELECT part_kind, count(*) AS n, count(DISTINCT annotation_id) AS docs, sum(frame_idx)::BIGINT AS frame_sum,
  sum(polygon_idx)::BIGINT AS polygon_sum, sum(child_idx)::BIGINT AS child_sum FROM found GROUP BY part_kind""",
}
