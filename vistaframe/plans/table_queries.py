"""Queries on the question-answer tables, and on the star schema where these have no counterpart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaframe.functions import numbers as N
from vistaframe.functions import text as T
from vistaframe.operators import curation as C
from vistaframe.operators import ranking as R
from vistaframe.operators import vocab as V
from vistaframe.plans import predict as P
from vistaframe.plans.catalogue import Catalogue
from vistaframe.sources.files import best_checkpoint, first_rows, flatten_cells, scene_index
from vistaframe.sources.tables import table

catalogue = Catalogue()
KEY = "Question_Id"
QA = [KEY, "IDs", "Questions", "Answers", "Image_Path", "Depth_Path", "Question_Type"]


def _qa(spark: SparkSession, folder: str, *names: str, columns: list[str] = QA) -> DataFrame:
    """The question-answer tables, each question once; its repeats are equal in all but the time of loading."""
    parts = [table(spark, folder, f"{n}_dataset", columns) for n in names or ("train", "val", "test")]
    return reduce(DataFrame.unionAll, parts).distinct()


def _sql(name: str) -> str:
    cols = ", ".join(QA)
    return f"SELECT DISTINCT {cols} FROM {name}_dataset"


_ALL = " UNION ALL ".join(_sql(n) for n in ("train", "val", "test"))
_NA = "'None', 'n/a', 'null', 'NA', 'nan'"


@catalogue("union_required", f"SELECT Question_Type, count(*) AS n, count(Answers) AS answered, count(Model_Answer) AS predicted FROM ({_ALL.replace('FROM', ', NULL::VARCHAR AS Model_Answer FROM')}) GROUP BY 1")
def union_required(spark: SparkSession, folder: str) -> DataFrame:
    """Union by name of tables that have the required columns; predictions lack two of them and are left out."""
    val = table(spark, folder, "val_dataset", QA).distinct().withColumn("Model_Answer", F.lit(None).cast("string"))
    frames = [_qa(spark, folder, "train"), val, _qa(spark, folder, "test"), table(spark, folder, "prediction")]
    u = C.union_required(frames)
    return u.groupBy("Question_Type").agg(F.count("*").alias("n"), F.count("Answers").alias("answered"), F.count("Model_Answer").alias("predicted"))


@catalogue("null_literals", f"SELECT Question_Type, count(*) AS n, count(CASE WHEN Answers NOT IN ({_NA}) THEN 1 END) AS present FROM ({_sql('val')}) GROUP BY 1")
def null_literals(spark: SparkSession, folder: str) -> DataFrame:
    return _qa(spark, folder, "val").groupBy("Question_Type").agg(F.count("*").alias("n"), F.count(T.without_na(F.col("Answers"))).alias("present"))


#: Letters, marks, digits and joiners of words, and white space, as classes of the SQL's patterns, whose own are those of ASCII.
_W = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
_S = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def _stripped(c: str) -> str:
    return f"lower(regexp_replace({c}, '^[{_S}]+|[{_S}]+$', '', 'g'))"


def _re(s: str) -> str:
    return s.replace("'", "''")


def _fold(column: str, repairs) -> str:
    """The repairs as SQL. A match takes the characters beside the word along, so each is made twice for words side by side."""
    out = column
    for word, by in repairs:
        after = rf"([{_W}])" if word.endswith("?") else rf"($|[^{_W}])"  # a boundary after a question mark is the start of a word
        for _ in range(2):
            out = f"regexp_replace({out}, '(^|[^{_W}]){_re(word)}{after}', '\\1{_re(by)}\\2', 'gi')"
    return out


def _noise(column: str) -> str:
    return rf"coalesce(regexp_matches({column}, 'wall\p{{Nd}}+|^i think(\r?\n|[\r\x{{85}}\x{{2028}}\x{{2029}}])?$', 'i'), false)"


def _all(column: str) -> str:
    return f"coalesce(regexp_matches({column}, '(^|[^{_W}])alls?($|[^{_W}])', 'i'), false)"


@catalogue("regex_repair", f"SELECT Question_Id, md5({_fold('Questions', [*T.QUESTION_REPAIRS, *T.REPAIRS])}) AS q, {_fold(_fold('Answers', [('grey', 'gray')]), [*T.ANSWER_REPAIRS, *T.REPAIRS])} AS a FROM ({_ALL})")
def regex_repair(spark: SparkSession, folder: str) -> DataFrame:
    """The repairs on every question and answer."""
    fixed = C.repaired(_qa(spark, folder))
    return fixed.select(KEY, F.md5("Questions").alias("q"), F.col("Answers").alias("a"))


@catalogue("drop_patterns", f"""
SELECT Question_Type, count(*) AS n, count(*) FILTER (WHERE {_all('Questions')} OR {_all('Answers')}) AS says_all, count(*) FILTER (WHERE {_noise('Questions')} OR {_noise('Answers')}) AS noise
FROM ({_ALL}) GROUP BY 1""")
def drop_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that say all, and noise, of every row."""
    n = lambda c: F.count_if(c).cast("long")
    rows = _qa(spark, folder)
    return rows.groupBy("Question_Type").agg(F.count("*").alias("n"), n(T.says_all(F.col("Questions"), F.col("Answers"))).alias("says_all"), n(T.is_noise(F.col("Questions")) | T.is_noise(F.col("Answers"))).alias("noise"))


@catalogue("normalize_answer", f"""
SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(lower(Answers), '[^{_W}{_S}]', '', 'g'), '[{_S}]+', ' ', 'g'), '^ | $', '', 'g') AS a FROM val_dataset WHERE Answers IS NOT NULL""")
def normalize_answer(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "val_dataset", ["Answers"]).where(F.col("Answers").isNotNull())
    return rows.select(T.normalized_answer(F.col("Answers")).alias("a")).distinct()


@catalogue("trailing_digits", r"SELECT s_suppkey, regexp_replace(s_name, '\b(\w+?)(\d+)\b', '\1', 'g') AS name FROM (SELECT s_suppkey, replace(s_name, '#', '') AS s_name FROM supplier)")
def trailing_digits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier", ["s_suppkey", "s_name"]).select("s_suppkey", T.without_trailing_digits(F.replace("s_name", F.lit("#"), F.lit(""))).alias("name"))


def _number(n: str) -> str:
    """The words of a whole number n, by a list w.word of those below 1000."""
    large = f"w.word[({n} // 1000) + 1] || ' thousand' || CASE WHEN {n} % 1000 = 0 THEN '' WHEN {n} % 1000 < 100 THEN ' and ' || w.word[({n} % 1000) + 1] ELSE ', ' || w.word[({n} % 1000) + 1] END"
    return f"CASE WHEN {n} < 0 OR {n} >= 1000000 THEN {n}::VARCHAR WHEN {n} < 1000 THEN w.word[{n} + 1] ELSE {large} END"


_BELOW_1000 = "w AS (SELECT [" + ", ".join(f"'{N._words(n)}'" for n in range(1000)) + "] AS word)"


@catalogue("number_words", f"WITH {_BELOW_1000}, e AS (SELECT event_id, (props::JSON->>'k')::INT AS k FROM events), o AS (SELECT o_orderkey AS event_id, o_custkey::INT * 7 - 100 AS k FROM orders) SELECT event_id, k, {_number('k')} AS word FROM (FROM e UNION ALL FROM o) CROSS JOIN w")
def number_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the numbers of events, and of numbers on both sides of the range made from orders."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    rows = table(spark, folder, "events", ["event_id", "props"]).select("event_id", k.alias("k"))
    orders = table(spark, folder, "orders", ["o_orderkey", "o_custkey"]).select(F.col("o_orderkey").alias("event_id"), (F.col("o_custkey").cast("int") * 7 - 100).alias("k"))
    return rows.unionAll(orders).select("event_id", "k", N.number_words(F.col("k").cast("long")).alias("word"))


_BALANCE = f"""
WITH q AS ({_sql('val')}), t AS (SELECT Question_Type, row_number() OVER (ORDER BY min(Question_Id), Question_Type) - 1 AS chunk FROM q WHERE Question_Type IS NOT NULL GROUP BY 1),
i AS (SELECT Image_Path, row_number() OVER (ORDER BY Image_Path) - 1 AS r FROM (SELECT DISTINCT Image_Path FROM q WHERE Image_Path IS NOT NULL)),
k AS (SELECT (SELECT count(*) FROM i) // (SELECT count(*) FROM t) AS k)"""


@catalogue("balance_by_type", _BALANCE + " SELECT q.Question_Id, q.Question_Type FROM q JOIN t USING (Question_Type) JOIN i USING (Image_Path) CROSS JOIN k WHERE i.r // k.k = t.chunk")
def balance_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return C.balance_by_type(_qa(spark, folder, "val"), order=KEY).select(KEY, "Question_Type")


_YESNO = f"""
WITH q AS ({_sql('val')}), y AS (SELECT Question_Id, lower(Answers) AS a, row_number() OVER (PARTITION BY lower(Answers) ORDER BY md5(Question_Id || '|42'), Question_Id) AS r FROM q WHERE Question_Type = 'Yes/No'),
n AS (SELECT count(*) // 2 AS target FROM y)
SELECT Question_Id FROM q WHERE Question_Type IS DISTINCT FROM 'Yes/No'
UNION ALL SELECT Question_Id FROM y CROSS JOIN n WHERE a IN ('yes', 'no') AND r <= target // 2"""


@catalogue("balance_yes_no", _YESNO)
def balance_yes_no(spark: SparkSession, folder: str) -> DataFrame:
    return C.balance_yes_no(_qa(spark, folder, "val")).select(KEY)


@catalogue("split_721", """
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) AS rn FROM documents), n AS (SELECT count(*) AS n FROM d),
b AS (SELECT floor(0.7::DOUBLE * n)::BIGINT AS a, floor(0.9::DOUBLE * n)::BIGINT AS b FROM n)
SELECT doc_id, CASE WHEN rn <= a THEN 'train' WHEN rn <= b THEN 'test' ELSE 'validation' END AS split,
       (rn - CASE WHEN rn <= a THEN 0 WHEN rn <= b THEN a ELSE b END)::BIGINT AS id_in_split FROM d CROSS JOIN b""")
def split_721(spark: SparkSession, folder: str) -> DataFrame:
    return C.split_721(table(spark, folder, "documents", ["doc_id"]), ["doc_id"])


@catalogue("sample_k", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || '|42'), o_orderkey) AS r FROM orders) WHERE r <= 500")
def sample_k(spark: SparkSession, folder: str) -> DataFrame:
    """A uniform sample of 500 orders; the size is the feature."""
    return C.pick(table(spark, folder, "orders", ["o_orderkey"]), 500, ["o_orderkey"])


@catalogue("prefix_subset", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r <= floor(n * 0.3::DOUBLE)")
def prefix_subset(spark: SparkSession, folder: str) -> DataFrame:
    return R.prefix(table(spark, folder, "orders", ["o_orderkey"]), ["o_orderkey"], 0.3)


@catalogue("batches", "SELECT batch_id, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 32 AS batch_id FROM orders) GROUP BY 1 HAVING count(*) = 32")
def batches(spark: SparkSession, folder: str) -> DataFrame:
    b = R.batches(table(spark, folder, "orders", ["o_orderkey"]), ["o_orderkey"], 32, drop_last=True)
    return b.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@catalogue("new_ids", f"SELECT Question_Id AS old_id, row_number() OVER (ORDER BY Question_Id)::BIGINT AS Question_Id FROM ({_ALL})")
def new_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive ids from 1 over all three splits."""
    return R.sequential_ids(_qa(spark, folder).select(F.col(KEY).alias("old_id")), ["old_id"], KEY)


@catalogue("row_cap", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 3")
def row_cap(spark: SparkSession, folder: str) -> DataFrame:
    """At most three orders of a customer; the cap is the feature."""
    return R.capped(table(spark, folder, "orders", ["o_custkey", "o_orderkey"]), ["o_custkey"], ["o_orderkey"], 3)


@catalogue("value_counts", "SELECT Answers, count(*) AS n FROM (SELECT DISTINCT Question_Id, Answers FROM train_dataset) WHERE Answers IS NOT NULL GROUP BY 1 ORDER BY n DESC, Answers LIMIT 20")
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 most frequent answers; the number is the feature."""
    rows = table(spark, folder, "train_dataset", [KEY, "Answers"]).distinct().where(F.col("Answers").isNotNull())
    return rows.groupBy("Answers").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "Answers").limit(20)


@catalogue("most_common", "SELECT event_type, count(*) AS n, min(event_id) AS first_at FROM events GROUP BY 1 ORDER BY n DESC, first_at LIMIT 3")
def most_common(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events", ["event_type", "event_id"])
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_at")).orderBy(F.desc("n"), "first_at").limit(3)


@catalogue("image_counts", f"SELECT Question_Type, count(Image_Path) AS paths, count(DISTINCT Image_Path) AS images FROM ({_ALL}) GROUP BY 1")
def image_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _qa(spark, folder).groupBy("Question_Type").agg(F.count("Image_Path").alias("paths"), F.countDistinct("Image_Path").alias("images"))


@catalogue("file_counts", """
SELECT f AS file, count(*) AS n FROM (SELECT 'train' AS f FROM train_dataset UNION ALL SELECT 'val' FROM val_dataset UNION ALL SELECT 'test' FROM test_dataset) GROUP BY ROLLUP (f)""")
def file_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each table, and of all."""
    parts = [table(spark, folder, f"{n}_dataset", [KEY]).select(F.lit(n).alias("file")) for n in ("train", "val", "test")]
    return reduce(DataFrame.unionAll, parts).rollup("file").agg(F.count("*").alias("n"))


@catalogue("noun_frequency", f"SELECT noun, count(*) AS n FROM (SELECT unnest(regexp_extract_all(Questions, 'How many ([{_W}]+) are there\\?', 1)) AS noun FROM (SELECT DISTINCT Question_Id, Questions FROM train_dataset)) GROUP BY 1")
def noun_frequency(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "train_dataset", [KEY, "Questions"]).distinct()
    return rows.select(F.explode(F.regexp_extract_all("Questions", F.lit(r"(?U)How many (\w+) are there\?"), F.lit(1))).alias("noun")).groupBy("noun").agg(F.count("*").alias("n"))


def _words_of(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[{_S}]+'), lambda t: t <> '')"


_TOKENS = _words_of("translate(lower(Questions), '?.,', '')")
_QVAL = "SELECT DISTINCT Question_Id, Questions FROM val_dataset WHERE Questions IS NOT NULL"
_VOCAB = f"""
WITH q AS ({_QVAL}), k AS (SELECT Question_Id, {_TOKENS} AS t FROM q), p AS (SELECT Question_Id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM k),
f AS (SELECT token, min((Question_Id, pos)) AS seen FROM p GROUP BY token), v AS (SELECT token, (row_number() OVER (ORDER BY seen) + 1)::BIGINT AS id FROM f)"""


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every question that is not null."""
    return table(spark, folder, "val_dataset", [KEY, "Questions"]).distinct().where(F.col("Questions").isNotNull())


@catalogue("word_vocabulary", _VOCAB + " SELECT token, id FROM v")
def word_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return V.word_vocabulary(_questions(spark, folder), KEY, T.question_tokens(F.col("Questions")))


@catalogue("encode_pad", _VOCAB + """, e AS (SELECT Question_Id, list(id ORDER BY pos) AS ids FROM (SELECT p.Question_Id, p.pos, v.id FROM p JOIN v USING (token) WHERE p.pos <= 15) GROUP BY 1)
SELECT k.Question_Id, array_to_string(list_concat(coalesce(e.ids, []), list_transform(range(0, 15), lambda i: 0::BIGINT))[1:15], ' ') AS ids FROM k LEFT JOIN e USING (Question_Id)""")
def encode_pad(spark: SparkSession, folder: str) -> DataFrame:
    """Fifteen ids for each question, as text."""
    q = _questions(spark, folder)
    e = V.encoded(q, KEY, T.question_tokens(F.col("Questions")), word_vocabulary(spark, folder))
    return e.select(KEY, F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


@catalogue("answer_vocabulary", f"SELECT token, (row_number() OVER (ORDER BY seen, token) - 1)::BIGINT AS id FROM (SELECT {_stripped('Answers')} AS token, min(Question_Id) AS seen FROM val_dataset WHERE Answers IS NOT NULL GROUP BY 1)")
def answer_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return V.answer_vocabulary(table(spark, folder, "val_dataset", [KEY, "Answers"]), KEY, F.lower(T.strip(F.col("Answers"))))


@catalogue("unknown_class", f"""
WITH v AS (SELECT token, row_number() OVER (ORDER BY seen, token) - 1 AS id FROM (SELECT {_stripped('Answers')} AS token, min(Question_Id) AS seen FROM val_dataset WHERE Answers IS NOT NULL GROUP BY 1))
SELECT class_id, count(*) AS n FROM (SELECT DISTINCT Question_Id, coalesce(v.id, 0)::BIGINT AS class_id FROM test_dataset t LEFT JOIN v ON v.token = {_stripped('t.Answers')}) GROUP BY 1""")
def unknown_class(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of another split as class ids; unknown ones are class 0."""
    rows = table(spark, folder, "test_dataset", [KEY, "Answers"]).distinct()
    return V.class_ids(rows, F.lower(T.strip(F.col("Answers"))), answer_vocabulary(spark, folder)).groupBy(F.col("class_id").cast("long").alias("class_id")).agg(F.count("*").alias("n"))


@catalogue("distinct_tokens", f"SELECT DISTINCT unnest({_words_of('Answers')}) AS token FROM val_dataset")
def distinct_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "val_dataset", ["Answers"])
    return rows.select(F.explode(N.tokens(F.col("Answers"))).alias("token")).distinct()


@catalogue("casefold_distinct", "SELECT DISTINCT lower(source) AS source FROM documents")
def casefold_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return C.casefold_distinct(table(spark, folder, "documents", ["source"]), "source")


@catalogue("unordered_pairs", "SELECT count(*) AS n, sum(a)::BIGINT AS sum_a, sum(b)::BIGINT AS sum_b FROM (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem)")
def unordered_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return C.unordered_pairs(table(spark, folder, "lineitem", ["l_partkey", "l_suppkey"]), "l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"))


@catalogue("oriented_pairs", """
WITH n AS (SELECT o_orderkey, o_custkey % 40 AS a, o_orderkey % 40 AS b FROM orders)
SELECT any_value(f.a) AS a, any_value(f.b) AS b FROM (SELECT least(a, b) AS low, greatest(a, b) AS high, arg_min(struct_pack(a := a, b := b), o_orderkey) AS f FROM n GROUP BY 1, 2) GROUP BY low, high""")
def oriented_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Unordered pairs, each the way round in which it came first."""
    rows = table(spark, folder, "orders", ["o_orderkey", "o_custkey"]).select("o_orderkey", (F.col("o_custkey") % 40).alias("a"), (F.col("o_orderkey") % 40).alias("b"))
    return C.unordered_pairs(rows, "a", "b", "o_orderkey")


@catalogue("scene_index", r"""
WITH s AS (SELECT DISTINCT scene_idx, string_split(replace(rgb_path, '\', '/'), '/') AS r, string_split(replace(depth_path, '\', '/'), '/') AS d FROM scene),
f AS (SELECT *, array_to_string(r[1:len(r) - 2], '/') AS kept FROM s), g AS (SELECT *, CASE WHEN contains(kept, 'SUNRGBD') THEN 'SUNRGBD/' || regexp_extract(kept, 'SUNRGBD/?(.*)$', 1) END AS folder FROM f)
SELECT DISTINCT scene_idx, folder || '/image/' || r[-1] AS rgb, folder || '/depth_bfx/' || d[-1] AS depth, folder || '/label/label.npy' AS label, folder || '/annotation/index.json' AS annotation FROM g""")
def scene_index_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Where the files of each scene lie, from the paths of its pictures."""
    name = lambda c: F.element_at(F.split(F.replace(F.col(c), F.lit("\\"), F.lit("/")), "/"), -1)
    return scene_index(table(spark, folder, "scene", ["scene_idx", "rgb_path", "depth_path"]), "scene_idx", "rgb_path", name("rgb_path"), name("depth_path")).distinct()


@catalogue("lookup_join", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def lookup_join(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders", ["o_custkey"])
    c = table(spark, folder, "customer", ["c_custkey", "c_mktsegment"])
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@catalogue("unprocessed", "SELECT DISTINCT scene_idx FROM scene WHERE scene_idx NOT IN (SELECT scene_idx FROM documents WHERE scene_idx IS NOT NULL)")
def unprocessed(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the one table that the other doesn't have yet: scenes that no text is about."""
    return C.without_files(table(spark, folder, "scene", ["scene_idx"]).distinct(), table(spark, folder, "documents", ["scene_idx"]), "scene_idx")


@catalogue("selected_images", "SELECT DISTINCT Question_Id FROM val_dataset WHERE Image_Path IN (SELECT rgb_path FROM scene WHERE sensor = 'dcam1')")
def selected_images(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "scene", ["rgb_path", "sensor"]).where("sensor = 'dcam1'").select(F.col("rgb_path").alias("Image_Path"))
    return table(spark, folder, "val_dataset", [KEY, "Image_Path"]).join(s, "Image_Path", "left_semi").select(KEY).distinct()


@catalogue("paths", r"""
SELECT DISTINCT Question_Id, '/data/SUNRGBD/' || regexp_replace(CASE WHEN strpos(p, 'SUNRGBD') > 0 THEN substr(p, 1, strpos(p, 'SUNRGBD') - 1) || substr(p, strpos(p, 'SUNRGBD') + 7) ELSE p END, '^/+', '') AS path, lpad(Question_Id::VARCHAR, 12, '0') AS padded
FROM (SELECT Question_Id, replace(Image_Path, '\', '/') AS p FROM val_dataset WHERE Image_Path IS NOT NULL)""")
def paths(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "val_dataset", [KEY, "Image_Path"]).where(F.col("Image_Path").isNotNull()).distinct()
    return rows.select(KEY, T.image_path("/data", F.col("Image_Path")).alias("path"), T.padded_id(F.col(KEY)).alias("padded"))


@catalogue("relative_paths", r"""
SELECT DISTINCT scene_idx, CASE WHEN contains(kept, 'SUNRGBD') THEN regexp_extract(kept, 'SUNRGBD/?(.*)$', 1) END AS folder
FROM (SELECT scene_idx, array_to_string(parts[1:len(parts) - 2], '/') AS kept FROM (SELECT scene_idx, string_split(replace(rgb_path, '\', '/'), '/') AS parts FROM scene))""")
def relative_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The folder of every scene row, NULL without the root."""
    rows = table(spark, folder, "scene", ["scene_idx", "rgb_path"])
    return rows.select("scene_idx", T.relative_path(F.col("rgb_path")).alias("folder")).distinct()


@catalogue("prompts", f"SELECT DISTINCT Question_Id, 'user: ' || Questions || '{T.SUFFIX_ONE_WORD}' || chr(10) || 'assistant: ' || Answers AS prompt FROM test_dataset")
def prompts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "test_dataset", [KEY, "Questions", "Answers"]).select(KEY, T.chat(F.col("Questions"), F.col("Answers")).alias("prompt")).distinct()


def _after_marker(rows: str) -> str:
    """CTEs that give ``said`` (all columns of rows, said): the text after the marker of its column text."""
    return f"""
{_BELOW_1000},
d AS (SELECT *, string_split(text, 'assistant') AS p FROM ({rows})),
k AS (SELECT *, {_words_of("lower(CASE WHEN len(p) > 1 THEN p[2] ELSE text END)")} AS t FROM d),
said AS (SELECT k.*, array_to_string(list_transform(k.t, lambda t: CASE WHEN NOT regexp_full_match(t, '[0-9]{{1,6}}') THEN t ELSE {_number('t::INT')} END), ' ') AS said FROM k CROSS JOIN w)"""


@catalogue("after_marker", f"WITH {_after_marker('SELECT doc_id, text FROM documents WHERE text IS NOT NULL')} SELECT doc_id, said FROM said")
def after_marker(spark: SparkSession, folder: str) -> DataFrame:
    """Text after the marker, of every text."""
    rows = table(spark, folder, "documents", ["doc_id", "text"]).where(F.col("text").isNotNull())
    return rows.select("doc_id", T.after_marker(F.col("text")).alias("said"))


def _asked(suffix: str) -> str:
    """What the stub of the model answers to the validation questions that have a picture."""
    return f"SELECT DISTINCT Question_Id, Questions, Question_Type, Answers, Depth_Path, 'user ' || Questions || '{suffix.replace(chr(39), chr(39) * 2)}' || ' assistant 2' AS text FROM val_dataset WHERE Image_Path IS NOT NULL"


_REFERENCE = _stripped("Answers")


@catalogue("predictions", f"WITH {_after_marker(_asked(T.SUFFIX_ONE_WORD))} SELECT Question_Id, Questions, Question_Type, {_REFERENCE} AS Answers, said AS Model_Answer FROM said")
def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The validation questions through the slot of a model, here its stub."""
    return P.predicted(_qa(spark, folder, "val"))


@catalogue("predictions_by_depth", f"WITH {_after_marker(_asked(T.SUFFIX_STRICT))} SELECT Question_Id, encoding, said AS Model_Answer FROM said CROSS JOIN (VALUES ('grey'), ('channels')) e(encoding)")
def predictions_by_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Each question asked with the depth picture as grey levels and as gradient channels."""
    encodings = {"grey": lambda path: F.concat(F.lit("grey:"), path), "channels": lambda path: F.concat(F.lit("channels:"), path)}
    return P.predicted_each(_qa(spark, folder, "val"), encodings).select(KEY, "encoding", "Model_Answer")


@catalogue("predictions_matched", f"""
WITH {_after_marker(_asked(T.SUFFIX_ONE_WORD))}, m AS (SELECT Question_Type, coalesce((said = {_REFERENCE})::INT, 0) AS hit FROM said)
SELECT Question_Type, count(*) AS n, sum(hit)::BIGINT AS matched, round(avg(hit), 9) AS accuracy FROM m GROUP BY 1""")
def predictions_matched(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions and their exact matches by type, in one plan."""
    return P.exact_report(P.predicted(_qa(spark, folder, "val")), ["Question_Type"]).withColumn("accuracy", F.round("accuracy", 9))


@catalogue("instructions", r"SELECT DISTINCT Question_Id, '<s>[INST] ' || Questions || chr(10) || '[IMG] ' || chr(10) || '[IMG] [/INST] ' || Answers || ' </s>' AS prompt FROM test_dataset")
def instructions(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations in the form of instructions, with marks for the two pictures."""
    return table(spark, folder, "test_dataset", [KEY, "Questions", "Answers"]).select(KEY, T.instruct(F.col("Questions"), F.col("Answers"), images=2).alias("prompt")).distinct()


@catalogue("padded_batches", f"""
WITH q AS (SELECT Question_Id, {_TOKENS} AS t FROM (SELECT DISTINCT Question_Id, Questions FROM test_dataset WHERE Questions IS NOT NULL)),
b AS (SELECT *, (row_number() OVER (ORDER BY Question_Id) - 1) // 16 AS batch_id FROM q), w AS (SELECT *, max(len(t)) OVER (PARTITION BY batch_id) AS width FROM b)
SELECT Question_Id, batch_id, array_to_string(list_concat(t, list_transform(range(0, (width - len(t))::BIGINT), lambda i: '<pad>')), ' ') AS tokens FROM w""")
def padded_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of test in batches of sixteen, each filled up to the longest of its batch."""
    rows = table(spark, folder, "test_dataset", [KEY, "Questions"]).distinct().where(F.col("Questions").isNotNull())
    padded = R.padded_batches(rows.select(KEY, T.question_tokens(F.col("Questions")).alias("tokens")), [KEY], "tokens", 16, F.lit("<pad>"))
    return padded.select(KEY, "batch_id", F.array_join("tokens", " ").alias("tokens"))


@catalogue("known_tokens", _VOCAB + f", k2 AS (SELECT DISTINCT Question_Id, Questions FROM test_dataset WHERE Questions IS NOT NULL), t AS (SELECT Question_Id, unnest({_TOKENS}) AS token FROM k2) SELECT DISTINCT Question_Id, token FROM t WHERE token IN (SELECT token FROM v)")
def known_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of the test questions that the vocabulary of another split holds: a semi join, whatever the vocabulary's size."""
    rows = table(spark, folder, "test_dataset", [KEY, "Questions"]).distinct().where(F.col("Questions").isNotNull())
    placed = rows.select(KEY, F.explode(T.question_tokens(F.col("Questions"))).alias("token")).distinct()
    return V.known(placed, "token", word_vocabulary(spark, folder))


@catalogue("questions_asked", "SELECT item, 'How many ' || item || 's are there?' AS how_many, 'What is closest to the ' || item || '?' AS closest, 'Is there no ' || item || '?' AS no FROM canonical_item WHERE kind = 'object'")
def questions_asked(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "canonical_item", ["item", "kind"]).where("kind = 'object'")
    i = F.col("item")
    return rows.select("item", T.asked("count", i).alias("how_many"), T.asked("closest", i).alias("closest"), T.asked("no", i).alias("no"))


@catalogue("min_val_loss", r"""
SELECT arg_min(path, (v, path)) AS path, min(v) AS val_loss FROM (
  SELECT path, coalesce(try_cast(regexp_extract(path, 'val_loss=([\d.]+)\.ckpt', 1) AS DOUBLE), 'inf'::DOUBLE) AS v
  FROM (SELECT 'run/val_loss=' || regexp_replace(printf('%.4f', round(value, 4)), '(\.\d+?)0+$', '\1') || '.ckpt' AS path FROM events WHERE value IS NOT NULL))""")
def min_val_loss(spark: SparkSession, folder: str) -> DataFrame:
    """The checkpoint of the least value, of all that are not null; the names have fixed decimals."""
    rows = table(spark, folder, "events", ["value"]).where(F.col("value").isNotNull())
    loss = F.regexp_replace(F.format_string("%.4f", F.round("value", 4)), r"(\.\d+?)0+$", "$1")
    return best_checkpoint(rows, F.concat(F.lit("run/val_loss="), loss, F.lit(".ckpt")))


@catalogue("first_available", """
WITH e AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' AND event_id % 3 <> 0 THEN event_id END AS v FROM events)
SELECT event_id, coalesce(min(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), min(v) OVER (PARTITION BY user_id)) AS available FROM e""")
def first_available(spark: SparkSession, folder: str) -> DataFrame:
    """The row's own value or the next one's of its group, from the start again at the end."""
    rows = table(spark, folder, "events", ["user_id", "event_id", "event_type"])
    rows = rows.withColumn("v", F.when((F.col("event_type") != "error") & (F.col("event_id") % 3 != 0), F.col("event_id")))
    return R.next_available(rows, "event_id", "v", "user_id").select("event_id", "available")


@catalogue("early_stop", """
WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM events WHERE value IS NOT NULL),
b AS (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
l AS (SELECT *, max(CASE WHEN before IS NULL OR value < before THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM b),
s AS (SELECT *, min(CASE WHEN epoch - last >= 3 THEN epoch END) OVER (PARTITION BY user_id) AS stop FROM l)
SELECT user_id, min(value) AS best, arg_min(epoch, (value, epoch))::INT AS best_epoch, any_value(stop)::INT AS stop_epoch FROM s WHERE stop IS NULL OR epoch <= stop GROUP BY 1""")
def early_stop(spark: SparkSession, folder: str) -> DataFrame:
    """Runs are users, epochs their events, the loss is the value."""
    from pyspark.sql.window import Window

    rows = table(spark, folder, "events", ["user_id", "event_id", "value"]).where("value IS NOT NULL")
    epochs = rows.withColumn("epoch", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return R.early_stop(epochs, "user_id", "epoch", "value", 3)


@catalogue("best_trial", "SELECT arg_min(user_id, (value, user_id)) AS user_id, min(value) AS best FROM events WHERE value IS NOT NULL")
def best_trial(spark: SparkSession, folder: str) -> DataFrame:
    """Users as trials."""
    return R.best_trial(table(spark, folder, "events", ["user_id", "value"]), "user_id", "value")


@catalogue("pruned_trials", """
WITH e AS (SELECT user_id % 40 AS trial, user_id // 40 AS step, min(value) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
b AS (SELECT trial, step, min(value) OVER (PARTITION BY trial ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM e)
SELECT trial, min(step) AS step FROM b WHERE step > 2 AND best > (SELECT median(o.best) FROM b o WHERE o.step = b.step AND o.trial <> b.trial) GROUP BY 1""")
def pruned_trials(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of users as trials: when each is given up against the median of the others."""
    rows = table(spark, folder, "events", ["user_id", "value"]).where(F.col("value").isNotNull())
    steps = rows.groupBy((F.col("user_id") % 40).alias("trial"), F.floor(F.col("user_id") / 40).alias("step")).agg(F.min("value").alias("value"))
    return R.pruned(steps, "trial", "step", "value", warmup=2)


@catalogue("zipped_positions", """
WITH v AS (SELECT Question_Id AS val_id, row_number() OVER (ORDER BY Question_Id) AS r FROM (SELECT DISTINCT Question_Id FROM val_dataset)),
w AS (SELECT Question_Id AS back_id, row_number() OVER (ORDER BY Question_Id DESC) AS r FROM (SELECT DISTINCT Question_Id FROM val_dataset)) SELECT val_id, back_id FROM v JOIN w USING (r)""")
def zipped_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Two orders of the same rows, side by side by position."""
    ids = table(spark, folder, "val_dataset", [KEY]).distinct()
    return R.zipped_by_position(ids.select(F.col(KEY).alias("val_id")), ids.select(F.col(KEY).alias("back_id")), ["val_id"], [F.desc("back_id")])


@catalogue("prominence_rows", """
WITH p AS (SELECT l_orderkey AS scene, l_suppkey AS obj, l_extendedprice AS area, l_quantity AS depth, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS pos FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY area DESC, pos) AS ar FROM p),
r2 AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY depth, ar) AS dr, count(*) OVER (PARTITION BY scene) AS n, max(CASE WHEN ar = 1 THEN area END) OVER (PARTITION BY scene) AS a1, max(CASE WHEN ar = 2 THEN area END) OVER (PARTITION BY scene) AS a2 FROM r),
o AS (SELECT scene, obj, max(ar) + max(dr) AS score, min(ar) AS f, any_value(n) AS n, any_value(a1) AS a1, any_value(a2) AS a2 FROM r2 GROUP BY scene, obj)
SELECT scene, arg_min(obj, (CASE WHEN n = 1 OR a1 > 1.3 * a2 THEN f ELSE score END, f)) AS obj FROM o GROUP BY scene""")
def prominence_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Prominence of scenes that come as rows: orders as scenes, suppliers as objects."""
    from pyspark.sql.window import Window

    cols = ["l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_quantity"]
    rows = table(spark, folder, "lineitem", cols)
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    return R.prominence_rows(rows.withColumn("pos", pos), "l_orderkey", "l_suppkey", F.col("l_extendedprice"), F.col("l_quantity"), F.col("pos"))


def curation(rows: str, also: str = "", shown: str = "") -> str:
    """The SQL of the curation of rows (Question_Id, Questions, Answers, Image_Path, Question_Type and the column also); shown:
    further columns of the result."""
    more = also and f", {also}"
    return f"""
WITH u AS ({rows}), x AS (SELECT Question_Id AS old_id, Questions AS q, Answers AS a, Image_Path, Question_Type{more} FROM u),
f AS (SELECT old_id, {_fold('q', [*T.QUESTION_REPAIRS, *T.REPAIRS])} AS Questions, {_fold(_fold('a', [('grey', 'gray')]), [*T.ANSWER_REPAIRS, *T.REPAIRS])} AS Answers, Image_Path, Question_Type{more} FROM x),
q AS (SELECT * FROM f WHERE NOT ({_noise('Questions')} OR {_noise('Answers')})),
t AS (SELECT Question_Type, row_number() OVER (ORDER BY min(old_id), Question_Type) - 1 AS chunk FROM q WHERE Question_Type IS NOT NULL GROUP BY 1),
i AS (SELECT Image_Path, row_number() OVER (ORDER BY Image_Path) - 1 AS r FROM (SELECT DISTINCT Image_Path FROM q WHERE Image_Path IS NOT NULL)),
k AS (SELECT (SELECT count(*) FROM i) // (SELECT count(*) FROM t) AS k),
b AS (SELECT q.* FROM q JOIN t USING (Question_Type) JOIN i USING (Image_Path) CROSS JOIN k WHERE i.r // k.k = t.chunk),
y AS (SELECT old_id, lower(Answers) AS a, row_number() OVER (PARTITION BY lower(Answers) ORDER BY md5(old_id || '|42'), old_id) AS r FROM b WHERE Question_Type = 'Yes/No'),
n AS (SELECT count(*) // 2 AS target FROM y),
z AS (SELECT old_id FROM b WHERE Question_Type IS DISTINCT FROM 'Yes/No' UNION ALL SELECT old_id FROM y CROSS JOIN n WHERE a IN ('yes', 'no') AND r <= target // 2)
SELECT row_number() OVER (ORDER BY old_id)::BIGINT AS Question_Id, b.Question_Type, b.Questions, b.Answers{shown} FROM z JOIN b USING (old_id)"""


@catalogue("curated", curation(_sql("val")))
def curated(spark: SparkSession, folder: str) -> DataFrame:
    """The whole curation of the validation split."""
    return C.curated([_qa(spark, folder, "val")]).select(KEY, "Question_Type", "Questions", "Answers")


@catalogue("train_rows", f"SELECT DISTINCT Question_Id, Questions AS question, {_stripped('Answers')} AS answer, Image_Path AS rgb, Depth_Path AS depth FROM train_dataset")
def train_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as a training loop reads them, bound by name."""
    rows = table(spark, folder, "train_dataset", [KEY, "Questions", "Answers", "Image_Path", "Depth_Path"]).distinct()
    return rows.select(KEY, F.col("Questions").alias("question"), F.lower(T.strip(F.col("Answers"))).alias("answer"), F.col("Image_Path").alias("rgb"), F.col("Depth_Path").alias("depth"))


@catalogue("last_in_batch", "SELECT batch_id, max(Question_Id) AS question_id FROM (SELECT Question_Id, (row_number() OVER (ORDER BY Question_Id) - 1) // 8 AS batch_id FROM (SELECT DISTINCT Question_Id FROM test_dataset)) GROUP BY 1")
def last_in_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The id a batch goes by: that of its last row."""
    b = R.batches(table(spark, folder, "test_dataset", [KEY]).distinct(), [KEY], 8)
    return b.groupBy("batch_id").agg(F.max_by(KEY, KEY).alias("question_id"))


@catalogue("pad_batches", f"""
WITH q AS (SELECT Question_Id, len({_TOKENS})::INT AS n FROM (SELECT DISTINCT Question_Id, Questions FROM test_dataset WHERE Questions IS NOT NULL)),
b AS (SELECT Question_Id, n, (row_number() OVER (ORDER BY Question_Id) - 1) // 16 AS batch_id FROM q)
SELECT batch_id, count(*) AS n, max(n) AS width, (max(n) * count(*) - sum(n))::BIGINT AS padding FROM b GROUP BY batch_id""")
def pad_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches padded to their longest question: how wide, and how much padding."""
    rows = table(spark, folder, "test_dataset", [KEY, "Questions"]).distinct().where(F.col("Questions").isNotNull())
    b = R.batches(rows.withColumn("ids", F.transform(T.question_tokens(F.col("Questions")), lambda t: F.length(t))), [KEY], 16)
    size = F.size("ids")
    wide = b.groupBy("batch_id").agg(F.count("*").alias("n"), F.max(size).alias("width"), F.sum(size.cast("long")).alias("filled"))
    return wide.select("batch_id", "n", "width", (F.col("n") * F.col("width") - F.col("filled")).alias("padding"))



@catalogue("rows_with_files", "SELECT DISTINCT Question_Id FROM val_dataset WHERE Image_Path IS NOT NULL AND Image_Path IN (SELECT rgb_path FROM scene)")
def rows_with_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose picture is there: the scenes stand for the listing of files."""
    rows = table(spark, folder, "val_dataset", [KEY, "Image_Path"])
    return C.with_files(rows, table(spark, folder, "scene", ["rgb_path"]), "Image_Path", "rgb_path").select(KEY).distinct()


@catalogue("max_rows_of_split", "SELECT split, scene_idx FROM (SELECT split, scene_idx, row_number() OVER (PARTITION BY split ORDER BY scene_idx) AS r FROM (SELECT DISTINCT split, scene_idx FROM scene)) WHERE r <= 40")
def max_rows_of_split(spark: SparkSession, folder: str) -> DataFrame:
    """The first 40 scenes of each split; the number is the feature."""
    return first_rows(table(spark, folder, "scene", ["split", "scene_idx"]).distinct(), "split", "scene_idx", 40)


@catalogue("sheet_cells", "SELECT item, count(*) AS n FROM (SELECT combined_word AS item FROM combined_word_map UNION ALL SELECT separated_word FROM combined_word_map) GROUP BY 1")
def sheet_cells(spark: SparkSession, folder: str) -> DataFrame:
    """All cells of a sheet as one list."""
    return flatten_cells(table(spark, folder, "combined_word_map")).groupBy("item").agg(F.count("*").alias("n"))


@catalogue("daquar_paths", "SELECT scene_idx, 'images/' || scene_idx || '.png' AS rgb, 'depth/' || scene_idx || '_depth.png' AS depth FROM (SELECT DISTINCT scene_idx FROM scene)")
def daquar_paths(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "scene", ["scene_idx"]).distinct()
    return ids.select("scene_idx", T.daquar_paths(F.col("scene_idx").cast("string")).alias("p")).select("scene_idx", "p.rgb", "p.depth")


@catalogue("rare_cap", "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1 UNION ALL SELECT 'click', least(25, count(*)) FROM events WHERE event_type = 'click' HAVING count(*) > 0")
def rare_cap(spark: SparkSession, folder: str) -> DataFrame:
    """Caps for named kinds; the cap is the feature, and off by default."""
    rows = C.capped_names(table(spark, folder, "events", ["event_id", "event_type"]), "event_type", "event_id", {"click": 25})
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))
