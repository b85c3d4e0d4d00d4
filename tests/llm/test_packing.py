"""Containers: classes filled by count, nothing lost, nothing over, little room left."""

import random

import pytest
from pyspark.sql import functions as F

from vistaframe.llm import packing as P


def class_of(size, capacity, classes):
    """Independently of the operator: the class of a size."""
    fits = capacity // max(size, 1)
    if fits <= classes:
        return fits
    i = 0
    while classes * 2 ** ((i + 1) / P.PER_DOUBLING) <= fits:
        i += 1
    return int(classes * 2 ** (i / P.PER_DOUBLING))


def harmonic_count(sizes, capacity, classes):
    """Containers of an independent harmonic packer that packs each class by itself."""
    count = {}
    for s in sizes:
        while s > capacity:
            count[1] = count.get(1, 0) + 1
            s -= capacity
        k = class_of(s, capacity, classes)
        count[k] = count.get(k, 0) + 1
    return {k: -(-n // k) for k, n in count.items()}


@pytest.mark.parametrize("seed", range(6))
def test_top_up(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 256, 1024])
    sizes = [rng.randint(0, capacity) if rng.random() < 0.5 else rng.randint(0, max(1, capacity // 10)) for _ in range(2000)]
    classes = {}
    for s in sizes:
        classes.setdefault(class_of(s, capacity, 8), []).append(s)
    bins = [v[i : i + k] for k, v in sorted(classes.items()) for i in range(0, len(v), k)]
    where = P.top_up(bins, capacity)
    load = {}
    for s, w in zip((s for b in bins for s in b), where):
        load[w] = load.get(w, 0) + s
    assert max(load.values()) <= capacity and set(load) == set(range(max(where) + 1)) and max(where) + 1 <= len(bins)
    if capacity >= 256:  # items of half the capacity and more cannot share; below that, room left is small
        least = max(-(-sum(sizes) // capacity), sum(s > capacity / 2 for s in sizes))
        assert max(where) + 1 <= 1.1 * least + 1


def test_edges_of_top_up():
    assert P.top_up([], 10) == [] and P.top_up([[0, 0]], 10) == [0, 0] and P.top_up([[10], [10]], 10) == [0, 1]
    assert P.top_up([[6], [5, 5], [4]], 10) == [0, 1, 1, 0]
    assert P.top_up([[6], [6], [4, 4, 2]], 10) == [0, 1, 1, 0, 2]  # the last container loses two of three


def test_harmonic(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 2, 3, 7, 12, 26, 33, 34, 49, 50, 51, 99, 100, 101, 250])) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    windows = spark.createDataFrame([(1, 100), (2, 300)], "window_id int, capacity_tokens int")
    counts = {}
    for classes in (2, 16):
        for capacity, window in ((100, 1), (300, 2)):
            out = [r for r in P.harmonic(df, windows, classes=classes).collect() if r["window_id"] == window]
            held = {}
            for r in out:
                assert r["class"] == class_of(r["size"], capacity, classes)
                held.setdefault(r["class"], {}).setdefault((r["block"], r["bin"]), []).append(r["size"])
            for k, bins in held.items():  # so many texts as the class says, but in the last container
                assert sorted(len(b) for b in bins.values())[1:] == [k] * (len(bins) - 1)
                assert all(sum(b) <= capacity for b in bins.values())
            counts[classes, capacity] = {k: len(b) for k, b in held.items()}
            assert counts[classes, capacity] == harmonic_count([n for _, n in rows], capacity, classes)
    assert counts[2, 100] != counts[16, 100]
    monkeypatch.setattr(P, "BLOCK_TEXTS", 50)  # blocks are packed by themselves: at most one container more for each
    blocked = P.harmonic(df, windows.where("window_id = 1"), classes=16).select("class", "block", "bin").distinct().count()
    assert sum(counts[16, 100].values()) <= blocked <= sum(counts[16, 100].values()) + 2000 / 50 + len(counts[16, 100])


def test_classes_change_the_packing(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, rng.randint(1, 700)) for i in range(2000)], "doc_id long, n_tokens long")
    windows = spark.createDataFrame([(1, 1024)], "window_id int, capacity_tokens int")

    def groups(classes):
        packed = P.containers(df, windows, classes=classes).groupBy("container_id").agg(F.sort_array(F.collect_list("doc_id")).alias("d"))
        return {tuple(r["d"]) for r in packed.collect()}

    assert groups(1) != groups(16)


def test_containers(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 5, 30, 99, 100, 101, 250, 1000, None])) for i in range(3000)] + [(None, 7)]
    df = spark.createDataFrame([(*r, "clash") for r in rows + rows[:100]], "doc_id long, n_tokens long, piece string")
    windows = spark.createDataFrame([(1, 100), (2, 300), (2, 300), (3, None)], "window_id int, capacity_tokens int")
    for blocks in (512, 4):
        monkeypatch.setattr(P, "BLOCK_CONTAINERS", blocks)
        out = P.containers(df, windows).collect()
        for w, cap in ((1, 100), (2, 300)):
            own = [r for r in out if r["window_id"] == w]
            load, size, pieces = {}, {}, {}
            for r in own:
                load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
                size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["n_tokens"]
                pieces.setdefault(r["doc_id"], []).append(r["piece"])
            assert max(load.values()) <= cap
            assert size == {i: n or 0 for i, n in rows}
            for i, n in rows:
                assert sorted(pieces[i]) == list(range(max(1, -(-(n or 0) // cap))))
            if blocks == 512:
                assert len(load) <= 1.05 * sum(size.values()) / cap + 2
    fill = {r["window_id"]: r for r in P.fill(df, windows).collect()}
    for w, cap in ((1, 100), (2, 300)):
        assert fill[w]["least"] <= fill[w]["containers"] <= fill[w]["harmonic"]
        assert fill[w]["harmonic"] == sum(harmonic_count([n or 0 for _, n in rows], cap, P.CLASSES).values())
    assert P.containers(df.limit(0), windows).count() == 0 and P.containers(df, windows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.containers(df, windows.withColumn("capacity_tokens", F.lit(0)))
