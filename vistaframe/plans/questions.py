"""Questions and answers from scenes. Every generator is one projection over the scene's row: no shuffle but the caps.

A generator gives (annotation_id, Questions, Answers, Question_Type) for the scenes it can ask about; ``failed`` counts the
others. ``completed`` adds what curation requires: IDs, which run over the scenes that succeed, in the order of their ids, and
the paths of the scene's pictures. Each takes the scenes as ``rows``, so that several can share those read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaframe.functions import geometry as G
from vistaframe.functions import text as T
from vistaframe.functions.numbers import number_words
from vistaframe.functions.slots import stub_color
from vistaframe.operators import scenes as S
from vistaframe.operators.curation import curated, union_required
from vistaframe.operators.ranking import capped, prefix, sequential_ids
from vistaframe.session import cut
from vistaframe.sources.tables import once, table

ID = "annotation_id"


def scene_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Scenes with the id and name of the prominent object. Rows sent again give the same row, and repeats are dropped when
    a scene has come down to its question, so that documents are not shuffled. Filters follow that step too: pushed below
    the steps of a scene, they would repeat them."""
    base = S.scenes(table(spark, folder, "annotation", [ID, "doc"]))
    chosen = S.with_prominent(base)
    inside = F.col("top").between(0, F.size("names") - 1)
    kind = F.get("kinds", F.col("top"))
    name = F.coalesce(F.get("names", F.col("top")), F.when(inside & (kind.isNotNull()), F.lit("Unknown")))
    return chosen.withColumn("top_name", F.when(inside, name))


def pairs_of(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """The map of words written together: a small table by contract."""
    rows = table(spark, folder, "combined_word_map").dropna().orderBy("combined_word").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a word map of more than 10000 entries")
    return [(r[0], r[1]) for r in rows]


def _answers(rows: DataFrame, kind: str, question: Column, answer: Column, key: str = ID) -> DataFrame:
    out = rows.select(key, question.alias("Questions"), answer.alias("Answers"), F.lit(kind).alias("Question_Type"))
    return once(out, key).where(F.col("Questions").isNotNull() & F.col("Answers").isNotNull())


def object_identification(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    """A scene without a valid object is an error row in the reference, so it gives none here."""
    rows = scene_rows(spark, folder) if rows is None else rows
    name = F.lower(T.processed_name(F.col("top_name"), pairs_of(spark, folder)))
    answer = F.when((name == "") | (name == "n/a"), "Cannot answer").otherwise(name)
    return _answers(rows, "Object Identification", T.asked("prominent"), answer)


def pictures_of(spark: SparkSession, folder: str) -> DataFrame:
    """(annotation_id, Image_Path, Depth_Path) of the scene of each record; NULL paths for a scene that is not listed."""
    links = table(spark, folder, "annotation", [ID, "scene_idx"]).groupBy(ID).agg(F.min("scene_idx").alias("scene_idx"))
    paths = table(spark, folder, "scene", ["scene_idx", "rgb_path", "depth_path"]).groupBy("scene_idx").agg(F.min("rgb_path").alias("Image_Path"), F.min("depth_path").alias("Depth_Path"))
    return links.join(paths, "scene_idx", "left").drop("scene_idx")


def color(spark: SparkSession, folder: str, model=stub_color, rows: DataFrame | None = None) -> DataFrame:
    """model: a column function from the object's name and the path of the scene's picture to the colour. It is asked once for
    each scene, after repeats are dropped, so that a dear model does no work twice."""
    rows = (scene_rows(spark, folder) if rows is None else rows).select(ID, T.processed_name(F.col("top_name"), pairs_of(spark, folder)).alias("name"))
    asked = once(rows, ID).where(F.col("name").isNotNull()).join(pictures_of(spark, folder), ID, "left")
    said = asked.select(ID, T.asked("color", F.col("name")).alias("Questions"), T.strip(model(F.col("name"), F.col("Image_Path"))).alias("Answers"), F.lit("Color Identification").alias("Question_Type"))
    return said.where(F.col("Answers").isNotNull())


def count(spark: SparkSession, folder: str, most: int = 1000, rows: DataFrame | None = None) -> DataFrame:
    """How many objects (not polygons) of a scene have the prominent object's processed name; at most so many questions for
    each raw name."""
    pairs = pairs_of(spark, folder)
    rows = scene_rows(spark, folder) if rows is None else rows
    processed = F.transform(F.filter("names", lambda n: n.isNotNull()), lambda n: T.processed_name(n, pairs))
    rows = rows.select(ID, "top_name", T.processed_name(F.col("top_name"), pairs).alias("name"), processed.alias("all"))
    counted = rows.select(ID, "top_name", "name", F.size(F.filter("all", lambda n: n == F.col("name"))).cast("long").alias("n"))
    kept = capped(once(counted, ID).where(F.col("top_name").isNotNull()), ["top_name"], [ID], most)
    return kept.select(ID, T.asked("count", F.col("name")).alias("Questions"), number_words(F.col("n")).alias("Answers"), F.lit("Count").alias("Question_Type"))


def proximity(spark: SparkSession, folder: str, farthest: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """The object closest to (or farthest from) the prominent one, by the centroids of the first frame."""
    pairs = pairs_of(spark, folder)
    rows = S.with_placed(scene_rows(spark, folder) if rows is None else rows)
    rows = rows.withColumn("own", F.get(F.filter("spots", lambda s: s["obj"] == F.col("top")), 0))
    rows = rows.select(ID, "names", "top_name", S.nearest(F.col("spots"), F.col("own"), farthest)["obj"].alias("other"))
    other = F.get("names", F.col("other"))
    kind = "farthest" if farthest else "closest"
    return _answers(rows, "Proximity", T.asked(kind, T.processed_name(F.col("top_name"), pairs)), T.processed_name(other, pairs))


def direction(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    """Where the first polygon of another name lies, seen from the prominent object."""
    rows = scene_rows(spark, folder) if rows is None else rows
    spots = F.filter(
        F.transform(S.candidates(F.col("names"), F.col("polygons")), lambda p: F.struct(F.get("names", p["object_idx"]).alias("name"), p["cx"].alias("cx"), p["cy"].alias("cy"))),
        lambda s: s["name"].isNotNull() & s["cx"].isNotNull(),
    )
    rows = rows.select(ID, "top_name", spots.alias("spots"))
    own = F.get(F.filter("spots", lambda s: s["name"] == F.col("top_name")), 0)
    other = F.get(F.filter("spots", lambda s: s["name"] != F.col("top_name")), 0)
    theta = G.angle(own["cx"], own["cy"], other["cx"], other["cy"])
    return _answers(rows, "Direction", T.asked("relative", F.lower(other["name"]), F.lower(F.col("top_name"))), G.direction(theta))


def yes_no(spark: SparkSession, folder: str, strict: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """Two rows a scene, with one id: the prominent object (yes) and a word of the vocabulary chosen by md5 of the id (no), which may
    be in the scene all the same unless strict. The reference list is the vocabulary."""
    items = [r[0] for r in table(spark, folder, "canonical_item").where("kind = 'object'").select(F.lower("item").alias("i")).distinct().orderBy("i").limit(10_001).collect()]
    if len(items) > 10_000:
        raise ValueError("a vocabulary of more than 10000 entries")
    rows = once((scene_rows(spark, folder) if rows is None else rows).select(ID, "names", F.lower("top_name").alias("name")), ID).where(F.col("name").isNotNull())
    words = F.array(*[F.lit(i) for i in items])
    present = F.transform(F.filter("names", lambda n: n.isNotNull()), F.lower)
    rows = rows.withColumn("free", F.array_except(words, F.concat(F.array("name"), present) if strict else F.array("name")))
    drawn = F.conv(F.substring(F.md5(F.col(ID).cast("string")), 1, 8), 16, 10).cast("long")
    no = F.get("free", F.when(F.size("free") > 0, F.pmod(drawn, F.size("free"))).cast("int"))
    two = F.array(F.struct(T.asked("any", F.col("name")).alias("Questions"), F.lit("yes").alias("Answers")), F.struct(T.asked("any", no).alias("Questions"), F.lit("no").alias("Answers")))
    return rows.select(ID, F.inline(two)).where(F.col("Questions").isNotNull()).withColumn("Question_Type", F.lit("Yes/No"))


def count_every(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    """How many objects have each processed name of a scene: a question for each name, not only the prominent one's."""
    pairs = pairs_of(spark, folder)
    rows = scene_rows(spark, folder) if rows is None else rows
    named = rows.select(ID, F.transform(F.filter("names", lambda n: n.isNotNull()), lambda n: T.processed_name(n, pairs)).alias("all"))
    each = once(named, ID).select(ID, F.explode("all").alias("name")).groupBy(ID, "name").agg(F.count("*").alias("n"))
    return each.select(ID, T.asked("count", F.col("name")).alias("Questions"), number_words(F.col("n")).alias("Answers"), F.lit("Count").alias("Question_Type"))


def yes_no_every(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    """Whether there is each item of the reference list: yes for the names of a scene, no for all other items. The list is
    small by contract; an item is a row for each scene, as the question is asked about each."""
    items = table(spark, folder, "canonical_item").where("kind = 'object'").select(F.lower("item").alias("item")).distinct().limit(10_001)
    words = sorted(r[0] for r in items.collect())
    if len(words) > 10_000:
        raise ValueError("a vocabulary of more than 10000 entries")
    rows = scene_rows(spark, folder) if rows is None else rows
    present = rows.select(ID, F.array_distinct(F.transform(F.filter("names", lambda n: n.isNotNull()), F.lower)).alias("names"), F.col("top").isNotNull().alias("asked"))
    present = once(present, ID).where(F.col("asked") & F.col("names").isNotNull())
    said = F.concat(
        F.transform("names", lambda n: F.struct(n.alias("name"), F.lit("yes").alias("said"))),
        F.transform(F.array_except(F.array(*[F.lit(w) for w in words]), F.col("names")), lambda n: F.struct(n.alias("name"), F.lit("no").alias("said"))),
    )
    each = present.select(ID, F.inline(said))
    return each.select(ID, T.asked("any", F.col("name")).alias("Questions"), F.col("said").alias("Answers"), F.lit("Yes/No").alias("Question_Type"))


def halved(qa: DataFrame) -> DataFrame:
    """The first half of the rows of Yes/No, as the generator keeps them: by scene, the yes of a scene first."""
    return prefix(qa, [ID, F.desc("Answers"), "Questions"], 0.5)


def completed(spark: SparkSession, folder: str, qa: DataFrame) -> DataFrame:
    """(annotation_id, IDs, Questions, Answers, Image_Path, Depth_Path, Question_Type): the rows of a generator as curation
    requires them. Only ids and paths are joined; a scene that is not listed has NULL paths."""
    placed = numbered(qa).join(pictures_of(spark, folder), ID, "left")
    return placed.select(ID, "IDs", "Questions", "Answers", "Image_Path", "Depth_Path", "Question_Type")


def generated(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The rows of all generators, complete, from scenes that are read and measured once."""
    rows = cut(once(scene_rows(spark, folder), ID), "scenes")
    parts = [object_identification(spark, folder, rows=rows), color(spark, folder, rows=rows), count(spark, folder, rows=rows), proximity(spark, folder, rows=rows), direction(spark, folder, rows=rows), halved(yes_no(spark, folder, rows=rows))]
    return [completed(spark, folder, qa) for qa in parts]


def chain(spark: SparkSession, folder: str, balance: bool = True) -> DataFrame:
    """From annotations to curated questions: all generators, union, new ids over the union, repair, filters and, but for
    training splits, balance (which keeps nothing if there are fewer pictures than types)."""
    union = union_required(generated(spark, folder))
    key = F.concat_ws("|", F.lpad(F.col(ID).cast("string"), 20, "0"), "Question_Type", "Questions", "Answers")
    return curated([sequential_ids(union.withColumn("_order", key), ["_order"], "Question_Id").drop("_order", ID)], balance=balance)


def failed(spark: SparkSession, folder: str) -> DataFrame:
    """(scenes, unreadable, without_prominent): what the generators cannot ask about."""
    base = S.with_prominent(S.scenes(table(spark, folder, "annotation", [ID, "doc"])))
    per = once(base.select(ID, "unreadable", F.col("top").isNull().alias("none")), ID)
    n = lambda c: F.count_if(c).cast("long")
    return per.groupBy().agg(F.count("*").alias("scenes"), n(F.col("unreadable")).alias("unreadable"), n(~F.col("unreadable") & F.col("none")).alias("without_prominent"))


def numbered(qa: DataFrame, order: str = ID) -> DataFrame:
    """qa with IDs from 1 over the scenes that succeeded."""
    ids = sequential_ids(qa.select(order).distinct(), [order], "IDs")
    return qa.join(ids, order)
