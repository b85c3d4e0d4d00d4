"""Prominence, neighbours and questions, against plain Python."""

import json
import math
import random

from pyspark.sql import functions as F

from vistaframe.operators import scenes as S
from vistaframe.operators.ranking import prominence_rows


def area(x, y):
    n = min(len(x), len(y))
    if n < 4:
        return 0.0
    return abs(sum(x[i] * y[(i + 1) % n] - x[(i + 1) % n] * y[i] for i in range(n))) / 2


def choose(polys, flagged=()):
    """polys: (object, area, depth) in order."""
    polys = [p for p in polys if p[0] not in flagged]
    if not polys:
        return None
    by_area = sorted(polys, key=lambda p: -p[1])
    if len(by_area) == 1 or by_area[0][1] > 1.3 * by_area[1][1]:
        return by_area[0][0]
    by_depth = sorted(enumerate(by_area), key=lambda t: t[1][2])
    ar, dr = {}, {}
    for i, p in enumerate(by_area):
        ar[p[0]] = i
    for d, (_, p) in enumerate(by_depth):
        dr[p[0]] = d
    order = list(dict.fromkeys(p[0] for p in by_area))
    return min(order, key=lambda o: ar[o] + dr[o])


def square(side, at=0):
    return {"x": [at, at + side, at + side, at], "y": [at, at, at + side, at + side]}


def docs_frame(spark, docs):
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "annotation_id long, doc string")


def test_prominence_of_random_scenes(spark):
    rng = random.Random(5)
    docs, want = [], []
    for _ in range(250):
        names = [rng.choice(["table", "chair", "wall", "wallet", "lamp", "ceiling fan"]) for _ in range(rng.randint(1, 5))]
        polygons, plain = [], []
        for _ in range(rng.randint(0, 6)):
            o, side = rng.randrange(len(names)), rng.choice([3, 10, 11, 12, 20])
            depth = rng.choice([None, 1.0, 2.0, 2.5])
            p = {"object": o} | square(side)
            if depth is not None:
                p["XYZ"] = [[0, 0, depth], None, [1, None, None], [1, 2]]
            polygons.append(p)
            plain.append((o, float(side * side), math.inf if depth is None else depth))
        docs.append({"objects": [{"name": n} for n in names], "frames": [{"polygon": polygons}]})
        want.append(choose(plain, {i for i, n in enumerate(names) if any(w in n for w in ("wal", "floor", "flor", "ceiling"))}))
    got = {r[0]: r[1] for r in S.with_prominent(S.scenes(docs_frame(spark, docs))).select("annotation_id", "top").collect()}
    assert [got[i] for i in range(len(docs))] == want


def top(spark, *docs):
    rows = S.with_prominent(S.scenes(docs_frame(spark, docs))).select("annotation_id", "top").collect()
    return [r[1] for r in sorted(rows)]


def test_prominence_edges(spark):
    scene = lambda *p, n=3: {"objects": [{"name": f"n{i}"} for i in range(n)], "frames": [{"polygon": list(p)}]}
    box = lambda o, w, h, **k: {"object": o, "x": [0, w, w, 0], "y": [0, 0, h, h]} | k
    assert top(
        spark,
        scene(box(0, 5, 5)),
        scene(box(0, 13, 1, XYZ=[[0, 0, 9.0]]), box(1, 10, 1, XYZ=[[0, 0, 1.0]])),  # exactly 1.3 times: ranks decide, tie to the larger
        scene(box(0, 12, 1, XYZ=[[0, 0, 9]]), box(1, 11, 1, XYZ=[[0, 0, 1]]), box(0, 10, 1)),
        scene(),
        scene({"object": 0, "x": 5, "y": 6}),  # coordinates that are no lists
        {"objects": [{"name": "wall"}, {"name": "floral"}, {"name": "wallet"}], "frames": [{"polygon": [box(0, 9, 9), box(2, 8, 8)]}]},
        {"objects": [[], {}], "frames": [{"polygon": [box(0, 9, 9), box(1, 1, 1)]}]},
    ) == [0, 0, 1, None, None, None, 0]


def test_neighbours_ties_and_alone(spark):
    at = lambda o, x, y: {"object": o, "x": [x, x], "y": [y, y]}
    docs = [
        {"objects": [{"name": "a"}, {"name": "b"}, {"name": "c"}, {"name": "floor"}], "frames": [{"polygon": [at(0, 0, 0), at(1, 1, 0), at(2, -1, 0), at(3, 0, 0)]}]},
        {"objects": [{"name": "a"}], "frames": [{"polygon": [at(0, 0, 0)]}]},
    ]
    got = {(r[0], r[1]): (r[2], r[3]) for r in S.neighbours(S.scenes(docs_frame(spark, docs))).collect()}
    assert got == {(0, 0): (1, 1), (0, 1): (0, 2), (0, 2): (0, 1), (1, 0): (None, None)}


def test_last_polygon_counts_at_the_place_of_the_first(spark):
    at = lambda o, x: {"object": o, "x": [x], "y": [0]}
    docs = [{"objects": [{"name": "a"}, {"name": "b"}], "frames": [{"polygon": [at(0, 0), at(1, 5), at(0, 9)]}]}]
    spots = S.with_placed(S.scenes(docs_frame(spark, docs))).select("spots").first()[0]
    assert [(s["ord"], s["obj"], s["cx"]) for s in spots] == [(0, 0, 9.0), (1, 1, 5.0)]


def test_prominence_of_rows(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for scene in range(200):
        polys = [(rng.randrange(3), float(rng.choice([4, 5, 6, 20])), float(rng.randrange(3))) for _ in range(rng.randint(1, 6))]
        rows += [(scene, o, a, d, i) for i, (o, a, d) in enumerate(polys)]
        want[scene] = choose(polys)
    df = spark.createDataFrame(rows, "s int, o int, a double, d double, p int")
    got = prominence_rows(df, "s", "o", F.col("a"), F.col("d"), F.col("p")).collect()
    assert {r[0]: r[1] for r in got} == want
