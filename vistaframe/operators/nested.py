"""Deeply nested records to flat tables with parent links, by single-pass tagged emission.

One expression walks each document depth first and returns an array of tagged rows (tag, own key, parent key, payload);
one ``inline`` then turns the array into rows. The document is parsed once, nothing is joined, and no Python runs. The
payload is a struct of typed fields, of which each tag fills its own. ``write_tables`` writes these rows partitioned by tag
and ``read_table`` applies the schema of a tag: its own fields, as columns. ``once`` drops documents sent again before they
are visited, so that only the few repeated ones are ever shuffled.

Defined cases
* null, empty, blank, malformed or truncated text, a document that isn't an object, and text after the object: one row
  with the tag ``bad``.
* a part that is missing, null or of another form: no rows of that part; positions count every element all the same.
* keys repeated in an object: the last one counts.
* a null id: the rows carry a null id. Repeated records: ``once`` keeps one of those with the same id and text (all of those
  with a null id); ``emit`` drops nothing.
* columns besides id and document: not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaframe.session import cut

TAGS = ("object", "frame", "polygon", "point", "bad")

#: Fields of the payload by tag, as (name, type, column of the table).
PAYLOAD = {
    "object": [("name", "string", "name"), ("is_object", "boolean", "is_object")],
    "frame": [("n_polygons", "int", "n_polygons")],
    "polygon": [("object_ref", "bigint", "object_ref"), ("xs", "array<double>", "x"), ("ys", "array<double>", "y"), ("n_points", "int", "n_points")],
    "point": [("px", "double", "x"), ("py", "double", "y"), ("pz", "double", "z")],
    "bad": [("n_chars", "int", "n_chars")],
}
_FIELDS = [(name, kind) for fields in PAYLOAD.values() for name, kind, _ in fields]
#: Ids of repeated records up to which their set is broadcast; beyond, it is joined by a shuffle.
MAX_REPEATED = 1_000_000


def parsed(doc: str | Column) -> Column:
    """VARIANT of a text that is one well-formed JSON object, else NULL.

    The parser behind ``try_parse_json`` stops after the first value, so the text is parsed as the first of two elements;
    the second is its hash, which the text cannot hold itself. Only if the parser gets there has it read the whole text."""
    doc = F.col(doc) if isinstance(doc, str) else doc
    mark = F.xxhash64(doc)
    whole = F.try_parse_json(F.concat(F.lit("["), doc, F.lit(", "), mark.cast("string"), F.lit("]")))
    first = F.try_variant_get(whole, "$[0]", "variant")
    return F.when((F.try_variant_get(whole, "$[1]", "bigint") == mark) & _is_object(first), first)


def _is_object(v: Column) -> Column:
    """An object can be read as a struct of any fields, missing ones NULL; nothing else can."""
    return F.try_variant_get(v, "$", "struct<`-`:variant>").isNotNull()


def _array(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def is_number(v: Column) -> Column:
    """True for a JSON number: neither a string that holds one, nor true or false."""
    return F.coalesce(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))


def numbers(v: Column, path: str) -> Column:
    """Numbers of a scalar or of an array, as array; elements that aren't numbers are left out."""
    one = F.try_variant_get(v, path, "variant")
    many = F.coalesce(_array(v, path), F.when(one.isNotNull(), F.array(one)), F.expr("array()").cast("array<variant>"))
    return F.transform(F.filter(many, is_number), lambda e: F.try_variant_get(e, "$", "double"))


def object_name(v: Column) -> Column:
    """``name`` if v is an object whose name is a string."""
    name = F.try_variant_get(v, "$.name", "variant")
    return F.when(F.schema_of_variant(name) == "STRING", F.try_variant_get(name, "$", "string"))


def object_names(df: DataFrame, id_col: str = "annotation_id", doc_col: str = "doc") -> DataFrame:
    """(id, object_idx INT, name): elements of ``objects`` that are objects with a string name."""
    doc = df.select(F.col(f"`{id_col}`").alias(id_col), parsed(F.col(f"`{doc_col}`")).alias("v"))
    named = F.filter(
        F.transform(_array(F.col("v"), "$.objects"), lambda o, i: F.struct(i.alias("object_idx"), object_name(o).alias("name"))),
        lambda s: s["name"].isNotNull(),
    )
    return doc.select(id_col, F.inline_outer(named)).where(F.col("name").isNotNull())


def once(df: DataFrame, id_col: str = "annotation_id", doc_col: str = "doc", most: int = MAX_REPEATED) -> DataFrame:
    """(<id>, <doc>), each id and text once. The ids are counted on their own, without the texts; only documents whose id
    comes more than once are compared, all others stay where they are read."""
    rows = df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{doc_col}`").alias(doc_col))
    repeated = cut(rows.groupBy(id_col).count().where(F.col("count") > 1).select(id_col), "repeated")
    side = F.broadcast(repeated) if repeated.count() <= most else repeated
    return rows.join(side, id_col, "left_anti").unionAll(rows.join(side, id_col, "left_semi").dropDuplicates([id_col, doc_col]))


def emit(df: DataFrame, id_col: str = "annotation_id", doc_col: str = "doc", payload: bool = True) -> DataFrame:
    """Rows (part_kind, <id>, frame_idx, polygon_idx, child_idx[, own_key, parent_key, payload]); -1 where an index does not apply.

    ``object``: child_idx is the position in objects. ``frame``: frame_idx. ``polygon``: child_idx is the position in
    objects that the polygon refers to, -1 if none. ``point``: child_idx is the position in XYZ. ``bad``: id only.
    own_key tells the rows of a tag in a document apart (``frame/polygon/point``); parent_key is the own_key one level up:
    that of the document, which is empty, for objects and frames, of the frame for polygons, of the polygon for points."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    doc = F.col("doc")
    minus = F.lit(-1)

    def key(*at: Column) -> Column:
        return F.concat_ws("/", *[c.cast("string") for c in at])

    def row(tag: str, frame: Column, polygon: Column, child: Column, own: Column | None = None, parent: Column | None = None, **load: Column) -> Column:
        fields = [F.lit(tag).alias("part_kind"), frame.alias("frame_idx"), polygon.alias("polygon_idx"), child.alias("child_idx")]
        if payload:
            filled = F.struct(*[load[name].cast(kind).alias(name) if name in load else F.lit(None).cast(kind).alias(name) for name, kind in _FIELDS])
            fields += [(F.lit("") if own is None else own).alias("own_key"), (F.lit("") if parent is None else parent).alias("parent_key"), filled.alias("payload")]
        return F.struct(*fields)

    def points(p: Column, fi: Column, pi: Column) -> Column:
        xyz = F.transform(_array(p, "$.XYZ"), lambda q, qi: F.struct(_array(q, "$").alias("a"), qi.alias("i")))
        good = F.filter(xyz, lambda s: F.coalesce((F.size(s["a"]) >= 3) & is_number(F.get(s["a"], 0)) & is_number(F.get(s["a"], 1)) & is_number(F.get(s["a"], 2)), F.lit(False)))
        value = lambda s, k: F.try_variant_get(F.get(s["a"], k), "$", "double")
        return F.transform(good, lambda s: row("point", fi, pi, s["i"], key(fi, pi, s["i"]), key(fi, pi), px=value(s, 0), py=value(s, 1), pz=value(s, 2)))

    def polygon(p: Column, fi: Column, pi: Column, n_objects: Column) -> Column:
        ref = F.try_variant_get(p, "$.object", "variant")
        at = F.when(F.schema_of_variant(ref) == "BIGINT", F.try_variant_get(ref, "$", "bigint"))
        child = F.coalesce(F.when((at >= 0) & (at < n_objects), at.cast("int")), minus)
        load = dict(object_ref=at, xs=numbers(p, "$.x"), ys=numbers(p, "$.y"), n_points=F.coalesce(F.size(_array(p, "$.XYZ")), F.lit(0))) if payload else {}
        own = F.array(row("polygon", fi, pi, child, key(fi, pi), key(fi), **load))
        return F.when(_is_object(p), F.concat(own, F.coalesce(points(p, fi, pi), none)))

    def frame(f: Column, fi: Column, n_objects: Column) -> Column:
        polygons = _array(f, "$.polygon")
        inner = F.flatten(F.transform(polygons, lambda p, pi: F.coalesce(polygon(p, fi, pi, n_objects), none)))
        return F.when(_is_object(f), F.concat(F.array(row("frame", fi, minus, minus, key(fi), n_polygons=F.coalesce(F.size(polygons), F.lit(0)))), F.coalesce(inner, none)))

    loads = f",own_key:string,parent_key:string,payload:struct<{','.join(f'{name}:{kind}' for name, kind in _FIELDS)}>" if payload else ""
    sample = f"array<struct<part_kind:string,frame_idx:int,polygon_idx:int,child_idx:int{loads}>>"
    none = F.expr("array()").cast(sample)
    objects = _array(doc, "$.objects")
    n_objects = F.coalesce(F.size(objects), F.lit(0))
    object_rows = F.transform(objects, lambda o, i: row("object", minus, minus, i, key(i), **(dict(name=object_name(o), is_object=_is_object(o)) if payload else {})))
    frame_rows = F.flatten(F.transform(_array(doc, "$.frames"), lambda f, fi: F.coalesce(frame(f, fi, n_objects), none)))
    bad_row = F.array(row("bad", minus, minus, minus, n_chars=F.length("text")))
    rows = F.when(doc.isNull(), bad_row.cast(sample)).otherwise(F.concat(F.coalesce(object_rows.cast(sample), none), F.coalesce(frame_rows.cast(sample), none)))
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{doc_col}`").alias("text")).select("id", "text", parsed("text").alias("doc"))
    # an outer generator: of others Spark computes the array twice, once to leave out rows whose array is empty
    out = source.select("id", F.inline_outer(rows)).where(F.col("part_kind").isNotNull()).withColumnRenamed("id", id_col)
    return out.select("part_kind", id_col, "frame_idx", "polygon_idx", "child_idx", *(["own_key", "parent_key", "payload"] if payload else []))


def write_tables(df: DataFrame, path: str, id_col: str = "annotation_id", doc_col: str = "doc") -> None:
    """All tables in one pass over df, partitioned by tag. Each task writes the tags it met; nothing is shuffled."""
    emit(df, id_col, doc_col).write.mode("overwrite").partitionBy("part_kind").parquet(path)


def schema_of(kind: str, id_col: str = "annotation_id") -> str:
    """Schema of what ``write_tables`` writes; kind: the type of the ids."""
    load = ", ".join(f"{name}: {of}" for name, of in _FIELDS)
    return f"`{id_col}` {kind}, frame_idx INT, polygon_idx INT, child_idx INT, own_key STRING, parent_key STRING, payload STRUCT<{load}>, part_kind STRING"


def read_table(spark: SparkSession, path: str, tag: str, id_col: str = "annotation_id", kind: str = "bigint") -> DataFrame:
    """The table of one tag, its payload as typed columns; only the tag's folder and its own fields are read."""
    rows = spark.read.schema(schema_of(kind, id_col)).parquet(path).where(F.col("part_kind") == tag)
    return rows.select(id_col, "frame_idx", "polygon_idx", "child_idx", "own_key", "parent_key", *[F.col(f"payload.{name}").alias(column) for name, _, column in PAYLOAD[tag]])
