"""Losses against plain formulas."""

import math
import random

from pyspark.sql import functions as F

from vistaframe.functions import losses as L


def softmax(v, t=1.0):
    top = max(v)
    e = [math.exp((x - top) / t) for x in v]
    return [x / sum(e) for x in e]


def test_losses(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 3) for _ in range(7)], [rng.gauss(0, 3) for _ in range(5)], rng.randrange(5)) for i in range(40)]
    rows.append((99, [0.0] * 7, [0.0, -200.0, 0.0, 0.0, 1.0], 0))  # the student's least probability
    df = spark.createDataFrame(rows, "i int, t array<double>, s array<double>, label int")
    t, s = F.col("t"), F.col("s")
    got = {r["i"]: r for r in df.select("i", L.kl_sum(t, s).alias("sum"), L.kl_mean(t, s).alias("mean"), L.student_loss(s, F.col("label")).alias("own"), L.loca(t, s, F.col("label")).alias("loca"), F.size(L.aligned(t, s)).alias("width")).collect()}
    for i, teacher, student, label in rows:
        p, q = softmax(teacher[:5], 2.0), softmax(student, 2.0)
        kl = sum(a * (math.log(a) - math.log(b)) for a, b in zip(p, q)) if min(q) > 0 else None
        own = -math.log(softmax(student)[label])
        second = sorted(p)[-2]
        at = [k for k, _ in sorted(enumerate(p), key=lambda x: (-x[1], x[0]))][1]
        k = 0.8 / (1 - p[label] + second)
        c = [1 - k * (sum(p) - p[label]) if j == label else k * x if j == at else x for j, x in enumerate(p)]
        loca = sum(a * (math.log(a) - math.log(max(b, 1e-8))) for a, b in zip(c, q) if a > 0) / 5 * 4 + own
        assert got[i]["width"] == 5 and abs(got[i]["own"] - own) < 1e-9 and abs(got[i]["loca"] - loca) < 1e-9
        if i != 99:
            assert abs(got[i]["sum"] - kl) < 1e-9 and abs(got[i]["mean"] - kl / 5 * 4) < 1e-9


def test_mixes(spark):
    parts = {k: F.lit(float(v)) for k, v in {"kl_mean": 1, "kl_batch": 10, "student": 100, "loca": 1000, "contrastive": 10000}.items()}
    got = spark.range(1).select(*[F.round(L.mix(name, parts), 9).alias(name) for name in L.MIXES]).first().asDict()
    assert got == {"vision": 5000.1, "calibration": 1000.0, "balanced": 820.0, "feature": 10080.1, "logit": 50.5, "combined": 11000.0, "language": 51.0}
