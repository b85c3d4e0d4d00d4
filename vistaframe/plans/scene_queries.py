"""Queries on annotation documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaframe.functions import geometry as G
from vistaframe.functions import numbers as N
from vistaframe.functions.text import is_stop_name
from vistaframe.operators import scenes as S
from vistaframe.operators.curation import without_objects
from vistaframe.plans import questions as Q
from vistaframe.plans.catalogue import Catalogue
from vistaframe.plans.table_queries import curation
from vistaframe.sources.tables import once, table

catalogue = Catalogue()
ID = Q.ID


def _scenes(spark: SparkSession, folder: str) -> DataFrame:
    return S.scenes(table(spark, folder, "annotation", [ID, "doc"]))


#: Scenes in SQL: readable documents, their objects, and the polygons of their first frames with measures.
SCENES = r"""
WITH docs AS (SELECT annotation_id, any_value(doc) AS doc FROM annotation GROUP BY annotation_id),
ok AS (
  SELECT annotation_id, doc::JSON AS j FROM docs
  WHERE json_valid(doc) AND json_type(doc) = 'OBJECT' AND NOT regexp_matches(regexp_replace(doc, '"(\\.|[^"\\])*"', '""', 'g'), ',\s*[\]}]')
), objs AS (
  SELECT annotation_id, unnest(range(json_array_length(j, '$.objects')::INT))::INT AS object_idx, unnest(json_extract(j, '$.objects[*]')) AS o
  FROM ok WHERE json_type(j, '$.objects') = 'ARRAY'
), named AS (
  SELECT annotation_id, object_idx, json_type(o) AS kind,
         CASE WHEN json_type(o) = 'OBJECT' AND json_type(o, '$.name') = 'VARCHAR' THEN json_extract_string(o, '$.name') END AS name FROM objs
), polys AS (
  SELECT annotation_id, unnest(range(json_array_length(j, '$.frames[0].polygon')::INT))::INT AS pos, unnest(json_extract(j, '$.frames[0].polygon[*]')) AS p
  FROM ok WHERE json_type(j, '$.frames[0].polygon') = 'ARRAY'
), listed AS (
  SELECT annotation_id, pos, p,
         CASE WHEN json_type(p, '$.object') IN ('BIGINT', 'UBIGINT') THEN json_extract(p, '$.object')::INT END AS object_idx,
         CASE WHEN json_type(p, '$.x') = 'ARRAY' THEN json_extract(p, '$.x')::DOUBLE[] WHEN json_type(p, '$.x') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN [json_extract(p, '$.x')::DOUBLE] ELSE [] END AS x,
         CASE WHEN json_type(p, '$.y') = 'ARRAY' THEN json_extract(p, '$.y')::DOUBLE[] WHEN json_type(p, '$.y') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN [json_extract(p, '$.y')::DOUBLE] ELSE [] END AS y,
         coalesce(json_type(p, '$.x') = 'ARRAY' AND json_type(p, '$.y') = 'ARRAY', false) AS lists
  FROM polys
), z AS (
  SELECT annotation_id, pos, unnest(json_extract(p, '$.XYZ[*]')) AS q FROM polys WHERE json_type(p, '$.XYZ') = 'ARRAY'
), depth AS (
  SELECT annotation_id, pos, count(*) AS n, avg(json_extract(q, '$[2]')::DOUBLE) FILTER (WHERE json_type(q) = 'ARRAY' AND json_type(q, '$[2]') IN ('BIGINT', 'UBIGINT', 'DOUBLE')) AS d
  FROM z GROUP BY annotation_id, pos
), sized AS (SELECT *, least(len(x), len(y))::INT AS n FROM listed),
measured AS (
  SELECT s.annotation_id, s.pos, s.object_idx, s.x, s.y, s.n,
         CASE WHEN s.n >= 4 THEN abs(list_sum(list_transform(range(1, s.n + 1), lambda i: x[i] * y[i % s.n + 1] - x[i % s.n + 1] * y[i]))) / 2 ELSE 0.0 END AS area,
         CASE WHEN d.n IS NULL THEN 'inf'::DOUBLE ELSE coalesce(d.d, 'nan'::DOUBLE) END AS depth,
         CASE WHEN s.n > 0 THEN list_sum(x[1:s.n]) / s.n END AS cx, CASE WHEN s.n > 0 THEN list_sum(y[1:s.n]) / s.n END AS cy,
         NOT s.lists OR s.object_idx IS NULL AS error
  FROM sized s LEFT JOIN depth d USING (annotation_id, pos)
), candidates AS (
  SELECT m.*, n.name FROM measured m LEFT JOIN named n USING (annotation_id, object_idx)
  WHERE NOT coalesce(contains(lower(n.name), 'wal') OR contains(lower(n.name), 'flor') OR contains(lower(n.name), 'floor') OR contains(lower(n.name), 'ceiling'), false)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY annotation_id ORDER BY area DESC, pos) AS ar FROM candidates
  WHERE annotation_id NOT IN (SELECT annotation_id FROM candidates WHERE error)
), r2 AS (
  SELECT *, row_number() OVER (PARTITION BY annotation_id ORDER BY depth, ar) AS dr, count(*) OVER (PARTITION BY annotation_id) AS cnt,
         max(CASE WHEN ar = 1 THEN area END) OVER (PARTITION BY annotation_id) AS a1, max(CASE WHEN ar = 2 THEN area END) OVER (PARTITION BY annotation_id) AS a2 FROM r
), o AS (
  SELECT annotation_id, object_idx, max(ar) + max(dr) AS score, min(ar) AS first_ar, any_value(cnt) AS cnt, any_value(a1) AS a1, any_value(a2) AS a2 FROM r2 GROUP BY ALL
), tops AS (
  SELECT annotation_id, object_idx AS top, row_number() OVER (PARTITION BY annotation_id ORDER BY CASE WHEN cnt = 1 OR a1 > 1.3 * a2 THEN first_ar ELSE score END, first_ar) AS k FROM o
), top AS (
  SELECT t.annotation_id, t.top, CASE WHEN n.kind IS NOT NULL THEN coalesce(n.name, 'Unknown') END AS top_name
  FROM tops t LEFT JOIN named n ON n.annotation_id = t.annotation_id AND n.object_idx = t.top WHERE k = 1
)"""


@catalogue("prominence", SCENES + " SELECT annotation_id, top AS object_idx, top_name AS name FROM top")
def prominence(spark: SparkSession, folder: str) -> DataFrame:
    rows = Q.scene_rows(spark, folder).select(ID, F.col("top").alias("object_idx"), F.col("top_name").alias("name"))
    return once(rows, ID).where(F.col("object_idx").isNotNull())


@catalogue("object_forms", SCENES + """
SELECT CASE WHEN name IS NOT NULL THEN 'named' WHEN kind = 'OBJECT' THEN 'Key not found' WHEN kind = 'ARRAY' THEN 'Cannot access key in a list' ELSE 'Unsupported type' END AS form,
       count(*) AS n FROM named GROUP BY 1""")
def object_forms(spark: SparkSession, folder: str) -> DataFrame:
    rows = once(_scenes(spark, folder).select(ID, "names", "kinds"), ID)
    at = F.sequence(F.lit(0), F.size("names") - 1)
    each = rows.where(F.size("names") > 0).select(F.explode(F.transform(at, lambda i: F.when(F.get("names", i).isNotNull(), "named").otherwise(S.name_of(F.col("names"), F.col("kinds"), i)))).alias("form"))
    return each.groupBy("form").agg(F.count("*").alias("n"))


@catalogue("stop_list", SCENES + """
SELECT contains(lower(name), 'wal') OR contains(lower(name), 'flor') OR contains(lower(name), 'floor') OR contains(lower(name), 'ceiling') AS stopped,
       count(*) AS n, count(DISTINCT name) AS names FROM named WHERE name IS NOT NULL GROUP BY 1""")
def stop_list(spark: SparkSession, folder: str) -> DataFrame:
    rows = once(_scenes(spark, folder).select(ID, "names"), ID).select(F.explode("names").alias("name")).where(F.col("name").isNotNull())
    return rows.groupBy(is_stop_name(F.col("name")).alias("stopped")).agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


@catalogue("polygon_measures", SCENES + """
SELECT annotation_id, pos, object_idx, n AS n_points, round(area, 6) + 0.0 AS area, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy,
       CASE WHEN isnan(depth) OR isinf(depth) THEN -1.0 ELSE round(depth, 6) + 0.0 END AS depth FROM measured""")
def polygon_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Area, centroid and mean depth of every polygon of a first frame; -1 for a depth that is infinite or unknown."""
    rows = once(_scenes(spark, folder).select(ID, "polygons"), ID).select(ID, F.inline("polygons"))
    r = lambda c: F.round(c, 6) + 0.0
    depth = F.when(F.isnan("depth") | (F.col("depth") == float("inf")), -1.0).otherwise(r("depth"))
    return rows.select(ID, "pos", "object_idx", G.common_length(F.col("x"), F.col("y")).alias("n_points"), r("area").alias("area"), r("cx").alias("cx"), r("cy").alias("cy"), depth.alias("depth"))


_SPOTS = SCENES + """, spots AS (
  SELECT annotation_id, object_idx, min(pos) AS ord, max_by(cx, pos) AS cx, max_by(cy, pos) AS cy, any_value(name) AS name
  FROM candidates WHERE cx IS NOT NULL AND object_idx IS NOT NULL GROUP BY annotation_id, object_idx
), pairs AS (
  SELECT a.annotation_id, a.object_idx, b.object_idx AS other, b.ord, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS d
  FROM spots a LEFT JOIN spots b ON a.annotation_id = b.annotation_id AND a.object_idx <> b.object_idx
), near AS (
  SELECT annotation_id, object_idx, arg_min(other, (d, ord)) AS closest, arg_min(other, (-d, ord)) AS farthest FROM pairs GROUP BY annotation_id, object_idx
)"""


@catalogue("neighbours", _SPOTS + " SELECT annotation_id, object_idx, closest, farthest FROM near")
def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Closest and farthest object of every object, within the scene's row: no join of a scene with itself."""
    return S.neighbours(_scenes(spark, folder), ID).distinct()


@catalogue("id_to_name", SCENES + """, f AS (
  SELECT annotation_id, unnest(json_extract(j, '$.frames[*]')) AS f FROM ok WHERE json_type(j, '$.frames') = 'ARRAY'
), refs AS (
  SELECT DISTINCT annotation_id, CASE WHEN json_type(p, '$.object') IN ('BIGINT', 'UBIGINT') THEN json_extract(p, '$.object')::INT END AS object_idx
  FROM (SELECT annotation_id, unnest(json_extract(f, '$.polygon[*]')) AS p FROM f WHERE json_type(f, '$.polygon') = 'ARRAY')
) SELECT annotation_id, object_idx, name FROM refs JOIN named USING (annotation_id, object_idx) WHERE name IS NOT NULL""")
def id_to_name(spark: SparkSession, folder: str) -> DataFrame:
    return S.name_by_id(table(spark, folder, "annotation", [ID, "doc"])).distinct()


@catalogue("first_of_name", SCENES + """
SELECT d.annotation_id, coalesce(min(n.object_idx) FILTER (WHERE n.name = 'table'), -1)::INT AS at FROM ok d LEFT JOIN named n USING (annotation_id) GROUP BY 1""")
def first_of_name(spark: SparkSession, folder: str) -> DataFrame:
    """Position of the first object named table, -1 if none."""
    rows = once(_scenes(spark, folder).select(ID, "unreadable", "names"), ID).where(~F.col("unreadable"))
    return rows.select(ID, F.coalesce(F.array_position(F.transform("names", lambda n: F.coalesce(n, F.lit(""))), "table") - 1, F.lit(-1)).cast("int").alias("at"))


@catalogue("first_polygon", SCENES + " SELECT annotation_id, object_idx, arg_min(n, pos)::INT AS n_points FROM measured WHERE object_idx IS NOT NULL GROUP BY ALL")
def first_polygon(spark: SparkSession, folder: str) -> DataFrame:
    rows = once(_scenes(spark, folder).select(ID, "polygons"), ID).select(ID, F.inline("polygons")).where(F.col("object_idx").isNotNull())
    return rows.groupBy(ID, "object_idx").agg(F.min_by(G.common_length(F.col("x"), F.col("y")), "pos").alias("n_points"))


@catalogue("prominence_class", SCENES + " SELECT coalesce(top_name, 'none') AS name, count(*) AS n FROM top GROUP BY 1")
def prominence_class(spark: SparkSession, folder: str) -> DataFrame:
    """How often a name is the prominent one."""
    return prominence(spark, folder).groupBy(F.coalesce("name", F.lit("none")).alias("name")).agg(F.count("*").alias("n"))


_SAID = """, spot AS (
  SELECT c.annotation_id, c.pos, c.name, c.cx, c.cy, t.top_name FROM candidates c JOIN top t USING (annotation_id) WHERE c.name IS NOT NULL AND c.cx IS NOT NULL AND t.top_name IS NOT NULL
), own AS (SELECT annotation_id, arg_min((cx, cy), pos) AS a FROM spot WHERE name = top_name GROUP BY 1),
other AS (SELECT annotation_id, any_value(top_name) AS top_name, arg_min(name, pos) AS name, arg_min((cx, cy), pos) AS b FROM spot WHERE name <> top_name GROUP BY 1),
ang AS (SELECT annotation_id, top_name, name, atan2(b[2] - a[2], b[1] - a[1]) AS t FROM own JOIN other USING (annotation_id)),
said AS (SELECT *,
  CASE WHEN t > -pi() / 2 AND t <= pi() / 2 THEN 'left' ELSE 'right' END AS h, CASE WHEN t > 0 AND t <= pi() THEN 'above' ELSE 'under' END AS v FROM ang)"""


_DIRECTION = """
SELECT annotation_id, 'Where is ' || lower(name) || ' relative to ' || lower(top_name) || '?' AS Questions,
  CASE WHEN abs(t) <= 0.01 THEN 'right' WHEN abs(t - pi()) <= 0.01 OR abs(t + pi()) <= 0.01 THEN 'left' WHEN abs(t - pi() / 2) <= 0.01 THEN 'above'
       WHEN abs(t + pi() / 2) <= 0.01 THEN 'under' ELSE h || ' and ' || v END AS Answers, 'Direction' AS Question_Type FROM said"""


@catalogue("qa_direction", SCENES + _SAID + _DIRECTION)
def qa_direction(spark: SparkSession, folder: str) -> DataFrame:
    return Q.direction(spark, folder)


@catalogue("direction_legacy", _SPOTS + """, a AS (
  SELECT s.annotation_id, s.object_idx, atan2(o.cy - s.cy, o.cx - s.cx) AS t FROM near n
  JOIN spots s ON s.annotation_id = n.annotation_id AND s.object_idx = n.object_idx JOIN spots o ON o.annotation_id = n.annotation_id AND o.object_idx = n.closest
) SELECT annotation_id, object_idx, CASE WHEN abs(t) < pi() / 4 OR abs(t) > 3 * pi() / 4 THEN CASE WHEN t > -pi() / 2 AND t <= pi() / 2 THEN 'left' ELSE 'right' END
  ELSE CASE WHEN t > 0 AND t <= pi() THEN 'above' ELSE 'under' END END AS direction FROM a""")
def direction_legacy(spark: SparkSession, folder: str) -> DataFrame:
    """The older direction word from each object to its closest neighbour."""
    spots = S.with_placed(_scenes(spark, folder)).select(ID, "spots")

    def each(o):
        other = F.get(F.filter("spots", lambda s: s["obj"] == S.nearest(F.col("spots"), o)["obj"]), 0)
        return F.struct(o["obj"].alias("object_idx"), G.direction_legacy(G.angle(o["cx"], o["cy"], other["cx"], other["cy"])).alias("direction"))

    return spots.select(ID, F.inline(F.transform("spots", each))).distinct().where(F.col("direction").isNotNull())


#: Letters, marks, digits and joiners of words, and white space, as classes of the SQL's patterns.
_W = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
_S = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def processed(names: str) -> str:
    """CTEs that give ``spoken`` (raw, name): every name of ``names`` (a query of one column raw) processed. Words written together
    are taken apart, those of several words first; then numbers become words, digits at ends go, and full stops at the end."""
    number = "CASE WHEN NOT regexp_full_match(t, '[0-9]{1,6}') THEN t WHEN t::INT < 1000 THEN n.word[t::INT + 1] ELSE n.word[(t::INT // 1000) + 1] || ' thousand' || CASE WHEN t::INT % 1000 = 0 THEN '' WHEN t::INT % 1000 < 100 THEN ' and ' || n.word[(t::INT % 1000) + 1] ELSE ', ' || n.word[(t::INT % 1000) + 1] END END"
    return rf"""
raws AS (SELECT DISTINCT raw FROM ({names}) WHERE raw IS NOT NULL),
cw AS (SELECT combined_word AS c, any_value(separated_word) AS s, regexp_full_match(combined_word, '\w+') AS single FROM combined_word_map WHERE combined_word IS NOT NULL AND separated_word IS NOT NULL GROUP BY ALL),
several AS (SELECT coalesce(list('(^|[^{_W}])' || regexp_escape(c) || '($|[^{_W}])' || chr(1) || '\1' || s || '\2' ORDER BY c), []) AS m FROM cw WHERE regexp_matches(c, '[^{_W}]')),
alone AS (SELECT map(list(lower(c)), list(s)) AS m FROM cw WHERE NOT regexp_matches(c, '[^{_W}]')),
number AS (SELECT [{', '.join(f"'{N._words(n)}'" for n in range(1000))}] AS word),
apart AS (SELECT raw, list_reduce(list_concat([raw], several.m), lambda t, p: regexp_replace(t, split_part(p, chr(1), 1), split_part(p, chr(1), 2), 'gi')) AS t FROM raws CROSS JOIN several),
single AS (SELECT raw, array_to_string(list_transform(regexp_extract_all(t, '[{_W}]+|[^{_W}]+'), lambda w: coalesce(alone.m[lower(w)], w)), '') AS t FROM apart CROSS JOIN alone),
worded AS (SELECT raw, array_to_string(list_transform(list_filter(string_split_regex(single.t, '[{_S}]+'), lambda t: t <> ''), lambda t: {number}), ' ') AS t FROM single CROSS JOIN number n),
spoken AS (SELECT raw, lower(rtrim(array_to_string(list_transform(regexp_extract_all(t, '[{_W}]+|[^{_W}]+'), lambda w: regexp_replace(w, '^([{_W}]+?)\p{{Nd}}+$', '\1')), ''), '.')) AS name FROM worded)"""


_TOPS = SCENES + "," + processed("SELECT top_name AS raw FROM top UNION SELECT name FROM named")


_OBJECT = """
SELECT annotation_id, 'What is the most prominent object?' AS Questions, CASE WHEN s.name IN ('', 'n/a') THEN 'Cannot answer' ELSE s.name END AS Answers, 'Object Identification' AS Question_Type
FROM top JOIN spoken s ON s.raw = top.top_name"""


@catalogue("qa_object", _TOPS + _OBJECT)
def qa_object(spark: SparkSession, folder: str) -> DataFrame:
    return Q.object_identification(spark, folder)


_COLOR = """
SELECT annotation_id, 'What is the color of the ' || s.name || '?' AS Questions,
  ['black', 'white', 'gray', 'brown', 'red', 'green', 'blue'][((('0x' || md5(s.name)[1:8])::BIGINT) % 7) + 1] AS Answers, 'Color Identification' AS Question_Type
FROM top JOIN spoken s ON s.raw = top.top_name"""


@catalogue("qa_color", _TOPS + _COLOR)
def qa_color(spark: SparkSession, folder: str) -> DataFrame:
    """The colour is that of the stub, which takes it from the name."""
    return Q.color(spark, folder)


_HELD = """, held AS (SELECT n.annotation_id, s.name, count(*) AS n FROM named n JOIN spoken s ON s.raw = n.name GROUP BY ALL)"""


_COUNT = """
SELECT annotation_id, 'How many ' || name || 's are there?' AS Questions, number.word[n + 1] AS Answers, 'Count' AS Question_Type FROM (
  SELECT top.annotation_id, top.top_name, s.name, coalesce(h.n, 0) AS n, row_number() OVER (PARTITION BY top.top_name ORDER BY top.annotation_id) AS k
  FROM top JOIN spoken s ON s.raw = top.top_name LEFT JOIN held h ON h.annotation_id = top.annotation_id AND h.name = s.name) CROSS JOIN number WHERE k <= 1000"""


@catalogue("qa_count", _TOPS + _HELD + _COUNT)
def qa_count(spark: SparkSession, folder: str) -> DataFrame:
    """At most a thousand questions for each raw name: the cap is the generator's."""
    return Q.count(spark, folder)


@catalogue("qa_count_every", _TOPS + _HELD + " SELECT annotation_id, 'How many ' || name || 's are there?' AS Questions, number.word[n + 1] AS Answers, 'Count' AS Question_Type FROM held CROSS JOIN number")
def qa_count_every(spark: SparkSession, folder: str) -> DataFrame:
    return Q.count_every(spark, folder)


_SPOKEN_SPOTS = _SPOTS + "," + processed("SELECT top_name AS raw FROM top UNION SELECT name FROM named")


def _proximity(kind: str) -> str:
    return f"""
SELECT top.annotation_id, 'What is {'closest' if kind == 'closest' else 'farthest'} to the ' || s.name || '?' AS Questions, z.name AS Answers, 'Proximity' AS Question_Type
FROM top JOIN spoken s ON s.raw = top.top_name JOIN near n ON n.annotation_id = top.annotation_id AND n.object_idx = top.top
JOIN named o ON o.annotation_id = top.annotation_id AND o.object_idx = n.{kind} JOIN spoken z ON z.raw = o.name"""


@catalogue("qa_closest", _SPOKEN_SPOTS + _proximity("closest"))
def qa_closest(spark: SparkSession, folder: str) -> DataFrame:
    return Q.proximity(spark, folder)


@catalogue("qa_farthest", _SPOKEN_SPOTS + _proximity("farthest"))
def qa_farthest(spark: SparkSession, folder: str) -> DataFrame:
    return Q.proximity(spark, folder, farthest=True)


@catalogue("qa_yes_no_every", SCENES + """, v AS (SELECT DISTINCT lower(item) AS w FROM canonical_item WHERE kind = 'object'),
t AS (SELECT annotation_id FROM top WHERE annotation_id IN (SELECT annotation_id FROM ok WHERE json_type(j, '$.objects') = 'ARRAY')),
y AS (SELECT DISTINCT annotation_id, lower(name) AS w FROM named JOIN t USING (annotation_id) WHERE name IS NOT NULL)
SELECT annotation_id, 'Is there any ' || w || '?' AS Questions, 'yes' AS Answers, 'Yes/No' AS Question_Type FROM y
UNION ALL SELECT annotation_id, 'Is there any ' || w || '?', 'no', 'Yes/No' FROM t CROSS JOIN v WHERE (annotation_id, w) NOT IN (SELECT annotation_id, w FROM y)""")
def qa_yes_no_every(spark: SparkSession, folder: str) -> DataFrame:
    return Q.yes_no_every(spark, folder)


_YES_NO = """, v AS (SELECT DISTINCT lower(item) AS w FROM canonical_item WHERE kind = 'object'),
t AS (SELECT annotation_id, lower(top_name) AS name FROM top WHERE top_name IS NOT NULL),
drawn AS (SELECT annotation_id, list(w ORDER BY w) AS free FROM t JOIN v ON v.w <> t.name GROUP BY 1),
neg AS (SELECT annotation_id, free[('0x' || md5(annotation_id::VARCHAR)[1:8])::BIGINT % len(free) + 1] AS w FROM drawn),
asked AS (
  SELECT annotation_id, 'Is there any ' || name || '?' AS Questions, 'yes' AS Answers FROM t UNION ALL SELECT annotation_id, 'Is there any ' || w || '?', 'no' FROM neg
), half AS (SELECT annotation_id, Questions, Answers FROM (SELECT *, row_number() OVER (ORDER BY annotation_id, Answers DESC, Questions) AS k, count(*) OVER () AS n FROM asked) WHERE k <= n // 2),
ids AS (SELECT annotation_id, row_number() OVER (ORDER BY annotation_id)::BIGINT AS IDs FROM (SELECT DISTINCT annotation_id FROM half)),
links AS (SELECT annotation_id, min(scene_idx) AS scene_idx FROM annotation GROUP BY 1), paths AS (SELECT scene_idx, min(rgb_path) AS Image_Path, min(depth_path) AS Depth_Path FROM scene GROUP BY 1)"""


@catalogue("qa_yes_no_half", SCENES + _YES_NO + " SELECT annotation_id, IDs, Questions, Answers, Image_Path, Depth_Path, 'Yes/No' AS Question_Type FROM half JOIN ids USING (annotation_id) LEFT JOIN links USING (annotation_id) LEFT JOIN paths USING (scene_idx)")
def qa_yes_no_half(spark: SparkSession, folder: str) -> DataFrame:
    """The half of the rows that the generator keeps, with ids and paths: the half is the feature."""
    return Q.completed(spark, folder, Q.halved(Q.yes_no(spark, folder)))


_CHAIN = _SPOKEN_SPOTS + _HELD + _SAID + _YES_NO + ", every AS (" + " UNION ALL ".join([_OBJECT, _COLOR, _COUNT, _proximity("closest"), _DIRECTION, "SELECT annotation_id, Questions, Answers, 'Yes/No' FROM half"]) + """
) SELECT row_number() OVER (ORDER BY lpad(annotation_id::VARCHAR, 20, '0') || '|' || Question_Type || '|' || Questions || '|' || Answers)::BIGINT AS Question_Id,
  dense_rank() OVER (PARTITION BY Question_Type ORDER BY annotation_id)::BIGINT AS IDs, Questions, Answers, Image_Path, Question_Type
FROM every LEFT JOIN links USING (annotation_id) LEFT JOIN paths USING (scene_idx) WHERE Questions IS NOT NULL AND Answers IS NOT NULL"""


@catalogue("qa_curated", curation(_CHAIN, "IDs", ", b.IDs, b.Image_Path"))
def qa_curated(spark: SparkSession, folder: str) -> DataFrame:
    """From annotations to curated questions by all generators."""
    return Q.chain(spark, folder).select("Question_Id", "IDs", "Questions", "Answers", "Image_Path", "Question_Type")


@catalogue("qa_yes_no", SCENES + """, v AS (SELECT DISTINCT lower(item) AS w FROM canonical_item WHERE kind = 'object'),
t AS (SELECT annotation_id, lower(top_name) AS name FROM top WHERE top_name IS NOT NULL),
drawn AS (SELECT annotation_id, list(w ORDER BY w) AS free FROM t JOIN v ON v.w <> t.name GROUP BY 1),
neg AS (SELECT annotation_id, free[('0x' || md5(annotation_id::VARCHAR)[1:8])::BIGINT % len(free) + 1] AS w FROM drawn)
SELECT annotation_id, 'Is there any ' || name || '?' AS Questions, 'yes' AS Answers, 'Yes/No' AS Question_Type FROM t
UNION ALL SELECT annotation_id, 'Is there any ' || w || '?', 'no', 'Yes/No' FROM neg""")
def qa_yes_no(spark: SparkSession, folder: str) -> DataFrame:
    return Q.yes_no(spark, folder)


@catalogue("qa_yes_no_strict", SCENES + """, v AS (SELECT DISTINCT lower(item) AS w FROM canonical_item WHERE kind = 'object'),
t AS (SELECT annotation_id, lower(top_name) AS name FROM top WHERE top_name IS NOT NULL),
free AS (SELECT annotation_id, w FROM t JOIN v ON v.w <> t.name WHERE (annotation_id, w) NOT IN (SELECT annotation_id, lower(name) FROM named WHERE name IS NOT NULL)),
drawn AS (SELECT annotation_id, list(w ORDER BY w) AS free FROM free GROUP BY 1),
neg AS (SELECT annotation_id, free[('0x' || md5(annotation_id::VARCHAR)[1:8])::BIGINT % len(free) + 1] AS w FROM drawn)
SELECT annotation_id, 'Is there any ' || name || '?' AS Questions, 'yes' AS Answers, 'Yes/No' AS Question_Type FROM t
UNION ALL SELECT annotation_id, 'Is there any ' || w || '?', 'no', 'Yes/No' FROM neg""")
def qa_yes_no_strict(spark: SparkSession, folder: str) -> DataFrame:
    return Q.yes_no(spark, folder, strict=True)


@catalogue("qa_failed", SCENES + """
SELECT count(*) AS scenes, count(*) FILTER (WHERE annotation_id NOT IN (SELECT annotation_id FROM ok)) AS unreadable,
       count(*) FILTER (WHERE annotation_id IN (SELECT annotation_id FROM ok) AND annotation_id NOT IN (SELECT annotation_id FROM top)) AS without_prominent FROM docs""")
def qa_failed(spark: SparkSession, folder: str) -> DataFrame:
    return Q.failed(spark, folder)


@catalogue("qa_numbered", SCENES + " SELECT annotation_id, row_number() OVER (ORDER BY annotation_id)::BIGINT AS IDs FROM top WHERE top_name IS NOT NULL")
def qa_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Ids over the scenes that a question was made for."""
    return Q.numbered(Q.object_identification(spark, folder)).select(ID, "IDs")


@catalogue("without_walls", SCENES + " SELECT annotation_id, object_idx, name FROM named WHERE NOT coalesce(contains(lower(name), 'wal') OR contains(lower(name), 'flor') OR contains(lower(name), 'floor') OR contains(lower(name), 'ceiling'), false)")
def without_walls(spark: SparkSession, folder: str) -> DataFrame:
    """Objects without the unwanted ones; the others keep their ids, so that polygons still find them."""
    rows = _scenes(spark, folder).select(ID, F.posexplode("names").alias("object_idx", "name")).distinct()
    return without_objects(rows, ID, "object_idx", rows.where(is_stop_name(F.col("name"))))


@catalogue("polygon_points", SCENES + " SELECT count(*) AS points, sum(x[i])::BIGINT AS sum_x, sum(y[i])::BIGINT AS sum_y FROM (SELECT x, y, unnest(range(1, n + 1)) AS i FROM measured)")
def polygon_points(spark: SparkSession, folder: str) -> DataFrame:
    rows = once(_scenes(spark, folder).select(ID, "polygons"), ID).select(F.inline("polygons")).select(F.inline(G.points(F.col("x"), F.col("y"))).alias("px", "py"))
    return rows.agg(F.count("*").alias("points"), F.sum("px").cast("long").alias("sum_x"), F.sum("py").cast("long").alias("sum_y"))
