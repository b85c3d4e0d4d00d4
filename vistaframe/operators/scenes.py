"""Objects and polygons of a scene, in the row of the scene: nothing of a document is shuffled to ask about it.

A scene frame has an id and the columns of ``scenes``: names ARRAY<STRING> (NULL where an element has no usable name),
kinds ARRAY<STRING> (OBJECT, ARRAY, ...), and polygons ARRAY<STRUCT<pos, object_idx, x, y, area, depth, cx, cy, error>> of the
first frame. A scene that cannot be asked about (a polygon whose coordinates are no lists, an id outside the objects) has
``error`` set where the reference would have raised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaframe.functions import geometry as G
from vistaframe.functions.text import is_stop_name
from vistaframe.operators.nested import is_number, numbers, object_name, parsed


def average_depth(polygon: Column) -> Column:
    """Mean of the numeric third coordinates: infinite without points, NaN if no point has one."""
    points = F.try_variant_get(polygon, "$.XYZ", "array<variant>")
    third = F.transform(F.filter(F.transform(points, lambda p: F.get(F.try_variant_get(p, "$", "array<variant>"), 2)), lambda z: z.isNotNull() & is_number(z)), lambda z: F.try_variant_get(z, "$", "double"))
    return F.when(F.coalesce(F.size(points), F.lit(0)) <= 0, float("inf")).otherwise(F.coalesce(G.mean_of(third), F.lit(float("nan"))))


def scenes(df: DataFrame, id_col: str = "annotation_id", doc_col: str = "doc") -> DataFrame:
    """The documents of df as scenes; those that are not readable have ``unreadable`` set and no parts.

    Each step is a projection of its own: what a later step uses more than once is computed once."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    source = df.select(F.col(f"`{id_col}`").alias(id_col), parsed(F.col(f"`{doc_col}`")).alias("v"))
    parts = source.select(
        id_col,
        F.col("v").isNull().alias("unreadable"),
        F.try_variant_get("v", "$.objects", "array<variant>").alias("objects"),
        F.try_variant_get("v", "$.frames[0].polygon", "array<variant>").alias("polys"),
    )

    def raw(p: Column, i: Column) -> Column:
        ref = F.try_variant_get(p, "$.object", "variant")
        listed = F.try_variant_get(p, "$.x", "array<variant>").isNotNull() & F.try_variant_get(p, "$.y", "array<variant>").isNotNull()
        at = F.when(F.schema_of_variant(ref) == "BIGINT", F.try_variant_get(ref, "$", "int"))
        return F.struct(
            i.alias("pos"), at.alias("object_idx"), numbers(p, "$.x").alias("x"), numbers(p, "$.y").alias("y"),
            average_depth(p).alias("depth"), (~listed | at.isNull()).alias("error"),
        )

    def measured(s: Column) -> Column:
        center = G.centroid(s["x"], s["y"])
        return F.struct(
            s["pos"].alias("pos"), s["object_idx"].alias("object_idx"), s["x"].alias("x"), s["y"].alias("y"), G.polygon_area(s["x"], s["y"]).alias("area"),
            s["depth"].alias("depth"), center["x"].alias("cx"), center["y"].alias("cy"), s["error"].alias("error"),
        )

    return parts.select(
        id_col,
        "unreadable",
        F.transform("objects", object_name).alias("names"),
        F.transform("objects", lambda o: F.regexp_extract(F.schema_of_variant(o), r"^(\w+)", 1)).alias("kinds"),
        F.transform(F.transform("polys", raw), measured).alias("polygons"),
    )


def name_of(names: Column, kinds: Column, at: Column) -> Column:
    """A name however the element is formed."""
    kind = F.get(kinds, at)
    return F.coalesce(
        F.get(names, at),
        F.when(kind == "OBJECT", "Key not found").when(kind == "ARRAY", "Cannot access key in a list").otherwise("Unsupported type"),
    )


def candidates(names: Column, polygons: Column) -> Column:
    """Polygons whose object isn't flagged by the stop list; nameless objects aren't flagged."""
    return F.filter(polygons, lambda p: ~F.coalesce(is_stop_name(F.get(names, p["object_idx"])), F.lit(False)))


def run_starts(sorted_: str) -> Column:
    """Where each object begins in a column of structs sorted by ``obj``."""
    at = F.when(F.size(sorted_) > 0, F.sequence(F.lit(0), F.size(sorted_) - 1))
    return F.filter(at, lambda i: (i == 0) | ~F.get(sorted_, i)["obj"].eqNullSafe(F.get(sorted_, i - 1)["obj"]))


def runs(sorted_: str, starts: str) -> Column:
    """The structs of each object, from columns of the sorted structs and of ``run_starts``: in all as many as there are, so that
    a scene takes time by its polygons and not by their square."""
    return F.transform(starts, lambda at, k: F.slice(sorted_, at + 1, F.coalesce(F.get(starts, k + 1), F.size(sorted_)) - at))


def with_prominent(df: DataFrame, ratio: float = 1.3, name: str = "top") -> DataFrame:
    """Scenes with the id of the most prominent object; NULL without candidates, or if a candidate's coordinates are no lists.

    The largest by area if it is alone or more than ratio times the second; else the least sum of area rank and depth rank,
    of an object's polygons the worst ranks, ties to the larger area. NaN depth ranks last."""
    by_area = F.array_sort(F.transform("_open", lambda p: F.struct((-p["area"]).alias("neg"), p["pos"].alias("pos"), p["depth"].alias("depth"), p["object_idx"].alias("obj"))))
    ranked = F.transform(by_area, lambda s, i: F.struct(s["depth"].alias("depth"), i.alias("ar"), s["obj"].alias("obj"), (-s["neg"]).alias("area")))
    both = F.transform(F.array_sort("_ranked"), lambda s, i: F.struct(s["obj"].alias("obj"), s["ar"].alias("ar"), i.alias("dr")))

    def score(own: Column) -> Column:
        """Of one object's polygons the worst ranks, and the place of the first."""
        return F.aggregate(
            own,
            F.struct(F.lit(-1).alias("ar"), F.lit(-1).alias("dr"), F.lit(1 << 30).alias("first")),
            lambda m, s: F.struct(F.greatest(m["ar"], s["ar"]).alias("ar"), F.greatest(m["dr"], s["dr"]).alias("dr"), F.least(m["first"], s["ar"]).alias("first")),
            lambda m: F.struct((m["ar"] + m["dr"]).alias("score"), m["first"].alias("first"), F.get(own, F.lit(0))["obj"].alias("obj")),
        )

    first, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    alone = (F.size("_ranked") == 1) | (first["area"] > ratio * second["area"])
    least = F.array_min(F.transform(runs("_both", "_starts"), score))
    ok = (F.size("_ranked") > 0) & ~F.exists("_open", lambda p: p["error"])
    steps = df.withColumn("_open", candidates(F.col("names"), F.col("polygons"))).withColumn("_ranked", ranked).withColumn("_both", F.array_sort(both)).withColumn("_starts", run_starts("_both"))
    return steps.withColumn(name, F.when(ok, F.when(alone, first["obj"]).otherwise(least["obj"]))).drop("_open", "_ranked", "_both", "_starts")


def with_placed(df: DataFrame, name: str = "spots") -> DataFrame:
    """Scenes with ARRAY<STRUCT<ord, obj, cx, cy>> of the candidates that have a centroid: an object's last polygon counts,
    at the place of its first."""
    open_ = F.filter(candidates(F.col("names"), F.col("polygons")), lambda p: p["cx"].isNotNull() & p["object_idx"].isNotNull())
    by_object = F.array_sort(F.transform("_open", lambda p: F.struct(p["object_idx"].alias("obj"), p["pos"].alias("pos"), p["cx"].alias("cx"), p["cy"].alias("cy"))))
    placed = F.transform(runs("_by_object", "_starts"), lambda own: F.struct(F.get(own, F.lit(0))["pos"].alias("first"), F.element_at(own, -1).alias("p")))
    spots = F.transform("_placed", lambda s, i: F.struct(i.alias("ord"), s["p"]["obj"].alias("obj"), s["p"]["cx"].alias("cx"), s["p"]["cy"].alias("cy")))
    steps = df.withColumn("_open", open_).withColumn("_by_object", by_object).withColumn("_starts", run_starts("_by_object")).withColumn("_placed", F.array_sort(placed))
    return steps.withColumn(name, spots).drop("_open", "_by_object", "_starts", "_placed")


def nearest(spots: Column, own: Column, farthest: bool = False) -> Column:
    """STRUCT(d, ord, obj) of the spot nearest to (or farthest from) own, which is a spot; ties to the first; NULL if alone."""
    sign = -1 if farthest else 1
    others = F.transform(
        F.filter(spots, lambda s: s["obj"] != own["obj"]),
        lambda s: F.struct((sign * G.distance(own["cx"], own["cy"], s["cx"], s["cy"])).alias("d"), s["ord"].alias("ord"), s["obj"].alias("obj")),
    )
    return F.array_min(others)


def neighbours(df: DataFrame, id_col: str = "annotation_id") -> DataFrame:
    """(<id>, object_idx, closest, farthest) of every placed object of a scene, within the scene's row."""
    spots = with_placed(df).select(id_col, "spots")
    pairs = F.transform("spots", lambda o: F.struct(o["obj"].alias("object_idx"), nearest(F.col("spots"), o)["obj"].alias("closest"), nearest(F.col("spots"), o, True)["obj"].alias("farthest")))
    return spots.select(id_col, F.inline_outer(pairs)).where(F.col("object_idx").isNotNull())


def name_by_id(df: DataFrame, id_col: str = "annotation_id", doc_col: str = "doc") -> DataFrame:
    """(<id>, object_idx, name): the objects that polygons of any frame refer to, each once."""
    source = df.select(F.col(f"`{id_col}`").alias(id_col), parsed(F.col(f"`{doc_col}`")).alias("v"))
    frames = F.try_variant_get("v", "$.frames", "array<variant>")
    polygons = F.flatten(F.transform(frames, lambda f: F.coalesce(F.try_variant_get(f, "$.polygon", "array<variant>"), F.expr("array()").cast("array<variant>"))))
    refs = F.array_distinct(F.filter(F.transform(polygons, lambda p: F.try_variant_get(p, "$.object", "int")), lambda o: o >= 0))
    objects = F.try_variant_get("v", "$.objects", "array<variant>")
    rows = source.select(id_col, objects.alias("objects"), F.explode_outer(refs).alias("object_idx"))
    return rows.select(id_col, "object_idx", object_name(F.get("objects", F.col("object_idx"))).alias("name")).where(F.col("name").isNotNull())
