"""Queries on vectors: losses, masks, fusion, pictures. The embeddings stand for logits, features and depth matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaframe.functions import arrays as A
from vistaframe.functions import geometry as G
from vistaframe.functions import losses as L
from vistaframe.operators.imaging import depth_channels, grey_channels
from vistaframe.operators.vectors import contrastive_loss
from vistaframe.plans.catalogue import Catalogue
from vistaframe.sources.tables import table

catalogue = Catalogue()


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings", ["vec_id", "embedding", "label"])
    return rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector with the one that follows it."""
    a = _vectors(spark, folder)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return a.join(b, "vec_id")


def _r(c: Column) -> Column:
    return F.round(c, 6) + 0.0


_V = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"
_P = _V + ", p AS (SELECT a.vec_id, a.v, b.v AS w, a.label FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)"


def _softmax(v: str, t: float = 1.0) -> str:
    e = f"list_transform({v}, lambda x: exp((x - list_max({v})) / {t}))"
    return f"list_transform({e}, lambda x: x / list_sum({e}))"


_S = _P + f""", m AS (SELECT vec_id, v, w, label, list_max(v) AS mv, list_max(w) AS mw FROM p),
x AS (SELECT *, list_transform(v, lambda x: exp((x - mv) / 2.0)) AS ev, list_transform(w, lambda x: exp((x - mw) / 2.0)) AS ew FROM m),
y AS (SELECT *, list_sum(ev) AS sv, list_sum(ew) AS sw FROM x),
s AS (SELECT vec_id, v, w, label, list_transform(ev, lambda x: x / sv) AS pt, list_transform(w, lambda x: (x - mw) / 2.0 - ln(sw)) AS lq, list_transform(v, lambda x: (x - mv) / 2.0 - ln(sv)) AS lp FROM y)"""


@catalogue("softmax", _S + " SELECT vec_id, round(list_max(pt), 6) AS top, round(list_min(pt), 6) AS least, round(list_sum(pt), 6) AS total, round(lq[1], 6) + 0.0 AS log_first FROM s")
def softmax(spark: SparkSession, folder: str) -> DataFrame:
    """Probabilities at temperature 2, and log-probabilities of the next vector."""
    rows = _pairs(spark, folder).select("vec_id", A.softmax(F.col("v"), 2.0).alias("p"), A.log_softmax(F.col("w"), 2.0).alias("lq"))
    return rows.select("vec_id", _r(F.array_max("p")).alias("top"), _r(F.array_min("p")).alias("least"), _r(A.total(F.col("p"))).alias("total"), _r(F.get("lq", F.lit(0))).alias("log_first"))


_KL = "list_sum(list_transform(range(1, len(pt) + 1), lambda i: pt[i] * (lp[i] - lq[i])))"


@catalogue("kl", _S + f", k AS (SELECT vec_id, {_KL} AS kl, list_sum(list_transform(range(1, len(pt) + 1), lambda i: exp(pt[i]) * (pt[i] - lq[i]))) AS quirk FROM s) SELECT vec_id, round(kl, 6) + 0.0 AS kl, round(kl / 64 * 4, 6) + 0.0 AS mean_t2, round(quirk, 6) + 0.0 AS log_target FROM k")
def kl(spark: SparkSession, folder: str) -> DataFrame:
    """Divergence of teacher and student: the sum, the mean times the squared temperature, and with log_target set."""
    rows = _pairs(spark, folder).select("vec_id", A.softmax(F.col("v"), 2.0).alias("p"), A.log_softmax(F.col("w"), 2.0).alias("lq"))
    k = A.kl(F.col("p"), F.col("lq"))
    return rows.select("vec_id", _r(k).alias("kl"), _r(k / 64 * 4).alias("mean_t2"), _r(A.kl(F.col("p"), F.col("lq"), log_target=True)).alias("log_target"))


@catalogue("loca", _S + """, t AS (SELECT vec_id, pt, lq, label, list_sort(pt, 'DESC')[2] AS p2, pt[label + 1] AS pg, list_sum(pt) AS total FROM s),
i AS (SELECT *, list_transform(range(1, 65), lambda i: struct_pack(p := -pt[i], i := i)) AS o FROM t),
j AS (SELECT *, list_sort(o)[2].i AS at2, 0.8 / (1 - pg + p2) AS k FROM i),
c AS (SELECT vec_id, lq, list_transform(range(1, 65), lambda i: CASE WHEN i = label + 1 THEN 1 - k * (total - pg) WHEN i = at2 THEN k * pt[i] ELSE pt[i] END) AS q FROM j),
l AS (SELECT vec_id, ln(list_sum(list_transform(w, lambda x: exp(x - mw)))) - (w[label + 1] - mw) AS sl FROM m)
SELECT vec_id, round(list_max(q), 6) AS top, round(list_sum(q), 6) AS total, round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q[i] > 0 THEN q[i] * (ln(q[i]) - ln(greatest(exp(lq[i]), 1e-8))) ELSE 0.0 END)) / 64 * 4 + sl, 6) + 0.0 AS loss FROM c JOIN l USING (vec_id)""")
def loca(spark: SparkSession, folder: str) -> DataFrame:
    """Teacher probabilities calibrated to the label, and the whole loss: clamp, squared temperature and the student's own."""
    rows = _pairs(spark, folder)
    q = A.calibrated(A.softmax(F.col("v"), 2.0), F.col("label"))
    return rows.select("vec_id", _r(F.array_max(q)).alias("top"), _r(A.total(q)).alias("total"), _r(L.loca(F.col("v"), F.col("w"), F.col("label"))).alias("loss"))


_MIX = _S + """, l AS (SELECT vec_id, ln(list_sum(list_transform(w, lambda x: exp(x - mw)))) - (w[label + 1] - mw) AS sl FROM m),
t AS (SELECT vec_id, pt, lq, lp, label, list_sort(pt, 'DESC')[2] AS p2, pt[label + 1] AS pg, list_sum(pt) AS total FROM s),
i AS (SELECT *, list_transform(range(1, 65), lambda i: struct_pack(p := -pt[i], i := i)) AS o FROM t),
j AS (SELECT *, list_sort(o)[2].i AS at2, 0.8 / (1 - pg + p2) AS k FROM i),
c AS (SELECT vec_id, lq, list_sum(list_transform(range(1, 65), lambda i: pt[i] * (lp[i] - lq[i]))) AS kl, list_transform(range(1, 65), lambda i: CASE WHEN i = label + 1 THEN 1 - k * (total - pg) WHEN i = at2 THEN k * pt[i] ELSE pt[i] END) AS q FROM j),
d AS (SELECT vec_id, vec_id // 8 AS b, kl, sl, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN q[i] > 0 THEN q[i] * (ln(q[i]) - ln(greatest(exp(lq[i]), 1e-8))) ELSE 0.0 END)) / 64 * 4 + sl AS loca FROM c JOIN l USING (vec_id)),
u AS (SELECT vec_id, vec_id // 8 AS b, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS te, list_transform(w, lambda x: x / greatest(sqrt(list_sum(list_transform(w, lambda y: y * y))), 1e-12)) AS st FROM p),
x2 AS (SELECT a.b, a.vec_id AS i, z.vec_id AS j, list_sum(list_transform(range(1, 65), lambda k: a.st[k] * z.te[k])) / 0.07 AS s FROM u a JOIN u z ON a.b = z.b),
y2 AS (SELECT b, i, max(s) + ln(sum(exp(s - m))) - max(CASE WHEN i = j THEN s END) AS l FROM (SELECT *, max(s) OVER (PARTITION BY b, i) AS m FROM x2) GROUP BY b, i),
con AS (SELECT b, avg(l) AS contrastive FROM y2 GROUP BY b),
parts AS (SELECT d.b AS batch_id, avg(kl) / 64 * 4 AS kl_mean, avg(kl) * 4 AS kl_batch, avg(sl) AS student, avg(loca) AS loca, any_value(contrastive) AS contrastive FROM d JOIN con ON con.b = d.b GROUP BY 1)"""


@catalogue("loss_mixes", _MIX + " SELECT batch_id, round(kl_batch, 6) + 0.0 AS kl_batch, " + ", ".join("round(" + " + ".join(f"{w} * {k}" for k, w in parts.items()) + f", 6) + 0.0 AS {name}" for name, parts in L.MIXES.items()) + " FROM parts")
def loss_mixes(spark: SparkSession, folder: str) -> DataFrame:
    """The losses of the trainers for batches of eight: the next vector stands for the student."""
    rows = _pairs(spark, folder).withColumn("batch_id", F.floor(F.col("vec_id") / 8))
    v, w, label = F.col("v"), F.col("w"), F.col("label")
    own = rows.groupBy("batch_id").agg(
        F.avg(L.kl_mean(v, w)).alias("kl_mean"), (F.avg(L.kl_sum(v, w)) * 4).alias("kl_batch"), F.avg(L.student_loss(w, label)).alias("student"), F.avg(L.loca(v, w, label)).alias("loca")
    )
    shared = contrastive_loss(rows.select("batch_id", "vec_id", A.unit(w).alias("student"), A.unit(v).alias("teacher")), "batch_id", "vec_id", "student", "teacher")
    both = own.join(shared.select("batch_id", F.col("loss").alias("contrastive")), "batch_id")
    parts = {name: F.col(name) for name in ("kl_mean", "kl_batch", "student", "loca", "contrastive")}
    return both.select("batch_id", _r(F.col("kl_batch")).alias("kl_batch"), *[_r(L.mix(name, parts)).alias(name) for name in L.MIXES])


@catalogue("cross_entropy", _S + ", c AS (SELECT vec_id, -lq[label + 1] AS ce, -list_sum(lq) / 64 * (1 + list_max(pt)) AS ofa FROM s) SELECT vec_id, round(ce, 6) + 0.0 AS ce, round(ofa, 6) + 0.0 AS ofa, round(0.1 * ofa + 0.8 * ce, 6) + 0.0 AS mixed FROM c")
def cross_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Cross-entropy at the label, the loss weighted by the teacher's confidence, and a mix of both."""
    rows = _pairs(spark, folder).select("vec_id", "label", A.softmax(F.col("v"), 2.0).alias("p"), A.log_softmax(F.col("w"), 2.0).alias("lq"))
    ce, ofa = -F.get("lq", F.col("label")), A.ofa_loss(F.col("p"), F.col("lq"))
    return rows.select("vec_id", _r(ce).alias("ce"), _r(ofa).alias("ofa"), _r(0.1 * ofa + 0.8 * ce).alias("mixed"))


@catalogue("jsd", _S + """, t AS (SELECT vec_id, pt, list_transform(lq, lambda x: exp(x)) AS q FROM s), mid AS (SELECT *, list_transform(range(1, 65), lambda i: (pt[i] + q[i]) / 2) AS m FROM t)
SELECT vec_id, round((list_sum(list_transform(range(1, 65), lambda i: pt[i] * (ln(pt[i]) - ln(m[i])))) + list_sum(list_transform(range(1, 65), lambda i: q[i] * (ln(q[i]) - ln(m[i]))))) / 2, 6) + 0.0 AS jsd FROM mid""")
def jsd(spark: SparkSession, folder: str) -> DataFrame:
    rows = _pairs(spark, folder).select("vec_id", A.softmax(F.col("v"), 2.0).alias("p"), A.softmax(F.col("w"), 2.0).alias("q"))
    return rows.select("vec_id", _r(A.jsd(F.col("p"), F.col("q"))).alias("jsd"))


_DOT = "list_sum(list_transform(range(1, 65), lambda i: {0}[i] * {1}[i]))"


@catalogue("cosine", _P + f", d AS (SELECT vec_id, label, {_DOT.format('v', 'w')} / (sqrt({_DOT.format('v', 'v')}) * sqrt({_DOT.format('w', 'w')})) AS c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - w[i]) * (v[i] - w[i]))) / 64 AS mse FROM p) SELECT vec_id, round(c, 6) + 0.0 AS cosine, round(mse, 6) AS mse, c >= 0.8 AS alike FROM d")
def cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity and squared error of each vector and the next, and whether they count as alike."""
    c = A.cosine(F.col("v"), F.col("w"))
    return _pairs(spark, folder).select("vec_id", _r(c).alias("cosine"), _r(A.mse(F.col("v"), F.col("w"))).alias("mse"), (c >= 0.8).alias("alike"))


@catalogue("category_similarity", _P + f", d AS (SELECT label, {_DOT.format('v', 'w')} / (sqrt({_DOT.format('v', 'v')}) * sqrt({_DOT.format('w', 'w')})) AS c FROM p) SELECT label, count(*) AS n, round(avg(c), 6) + 0.0 AS similarity FROM d GROUP BY 1")
def category_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).groupBy("label").agg(F.count("*").alias("n"), _r(F.avg(A.cosine(F.col("v"), F.col("w")))).alias("similarity"))


@catalogue("mean_pool", _V + """, u AS (SELECT label, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2)
SELECT label, round(sqrt(sum(x * x)), 6) AS norm, round(sum(x), 6) + 0.0 AS total FROM m GROUP BY 1""")
def mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vector of each label: sums by position, so that no group of vectors is gathered."""
    rows = _vectors(spark, folder).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    return rows.groupBy("label").agg(_r(F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("norm"), _r(F.sum("x")).alias("total"))


@catalogue("contrastive", _V + """, g AS (SELECT vec_id, vec_id // 8 AS b, v FROM e), n AS (SELECT vec_id, b, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS u FROM g),
t AS (SELECT vec_id, b, list_transform(u, lambda x: x * 0.5 + 0.01) AS t FROM n), w AS (SELECT vec_id, b, list_transform(t, lambda x: x / greatest(sqrt(list_sum(list_transform(t, lambda y: y * y))), 1e-12)) AS t FROM t),
s AS (SELECT n.b, n.vec_id AS i, w.vec_id AS j, list_sum(list_transform(range(1, 65), lambda k: n.u[k] * w.t[k])) / 0.07 AS s FROM n JOIN w ON n.b = w.b),
l AS (SELECT b, i, max(s) + ln(sum(exp(s - m))) - max(CASE WHEN i = j THEN s END) AS l FROM (SELECT *, max(s) OVER (PARTITION BY b, i) AS m FROM s) GROUP BY b, i)
SELECT b AS batch_id, count(*) AS n, round(avg(l), 6) + 0.0 AS loss FROM l GROUP BY 1""")
def contrastive(spark: SparkSession, folder: str) -> DataFrame:
    """Contrastive loss of vectors and shifted copies, in batches of eight."""
    rows = _vectors(spark, folder).select("vec_id", F.floor(F.col("vec_id") / 8).alias("batch_id"), A.unit(F.col("v")).alias("student"))
    rows = rows.withColumn("teacher", A.unit(F.transform("student", lambda x: x * 0.5 + 0.01)))
    return contrastive_loss(rows, "batch_id", "vec_id", "student", "teacher").select("batch_id", "n", _r(F.col("loss")).alias("loss"))


_F = {"product": "v[i] * w[i]", "sum": "v[i] + w[i]", "max": "greatest(v[i], w[i])", "weighted": "0.5 * v[i] + 0.5 * w[i]"}


@catalogue("fusion", _P + " SELECT vec_id, " + ", ".join(f"round(list_sum(list_transform(range(1, 65), lambda i: {e})), 6) + 0.0 AS {k}" for k, e in _F.items()) + ", len(v) + len(w) AS concat FROM p")
def fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Five ways to fuse two feature vectors."""
    cols = [_r(A.total(A.fused(F.col("v"), F.col("w"), k))).alias(k) for k in _F]
    return _pairs(spark, folder).select("vec_id", *cols, F.size(A.fused(F.col("v"), F.col("w"), "concat")).cast("long").alias("concat"))


@catalogue("linear_layer", _V + " SELECT vec_id, round(v[1] * 0.5 - v[2] + 0.1, 6) + 0.0 AS a, round(v[1] + v[2] * 2.0 - 0.2, 6) + 0.0 AS b FROM e")
def linear_layer(spark: SparkSession, folder: str) -> DataFrame:
    y = A.linear(F.slice("v", 1, 2), [[0.5, -1.0], [1.0, 2.0]], [0.1, -0.2])
    return _vectors(spark, folder).select("vec_id", y.alias("y")).select("vec_id", _r(F.get("y", F.lit(0))).alias("a"), _r(F.get("y", F.lit(1))).alias("b"))


@catalogue("argmax_topk", _V + """, o AS (SELECT vec_id, list_position(v, list_max(v)) - 1 AS am, list_sort(list_transform(range(1, 65), lambda i: struct_pack(x := -v[i], i := i))) AS o FROM e)
SELECT vec_id, am::INT AS argmax, (o[1].i - 1) || ' ' || (o[2].i - 1) AS top2 FROM o""")
def argmax_topk(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("v")
    return _vectors(spark, folder).select("vec_id", A.argmax(v).alias("argmax"), F.array_join(F.transform(A.top_k(v, 2), lambda i: i.cast("string")), " ").alias("top2"))


_IDS = "list_transform(v, lambda x: (abs(floor(x * 3)) % 4)::INT)"


@catalogue("find_subsequence", _V + f""", i AS (SELECT vec_id, {_IDS} AS a FROM e), b AS (SELECT vec_id, a, a[11:13] AS b FROM i),
f AS (SELECT vec_id, a, b, list_filter(range(0, 62), lambda k: a[k + 1:k + 3] = b)[1] AS s FROM b)
SELECT vec_id, s::INT AS found, list_sum(list_transform(range(0, 64), lambda k: CASE WHEN k >= s AND k < s + 3 THEN a[k + 1] ELSE -100 END))::BIGINT AS masked FROM f""")
def find_subsequence(spark: SparkSession, folder: str) -> DataFrame:
    """The first place of three ids within a row of ids, and all others masked."""
    rows = _vectors(spark, folder).select("vec_id", F.transform("v", lambda x: (F.abs(F.floor(x * 3)) % 4).cast("int")).alias("a"))
    b = F.slice("a", 11, 3)
    return rows.select("vec_id", A.find_subsequence(F.col("a"), b).alias("found"), F.aggregate(A.masked_outside(F.col("a"), b), F.lit(0).cast("long"), lambda s, x: s + x).alias("masked"))


@catalogue("label_mask", _V + f", i AS (SELECT vec_id, {_IDS} AS a FROM e) SELECT vec_id, list_sum(list_transform(a, lambda t: CASE WHEN t = 0 THEN -100 ELSE t END))::BIGINT AS total, len(list_filter(a, lambda t: t = 0)) AS pads FROM i")
def label_mask(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vectors(spark, folder).select("vec_id", F.transform("v", lambda x: (F.abs(F.floor(x * 3)) % 4).cast("int")).alias("a"))
    m = A.masked_labels(F.col("a"))
    return rows.select("vec_id", F.aggregate(m, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.size(F.filter(m, lambda t: t == -100)).cast("long").alias("pads"))


@catalogue("restricted_tokens", _V + " SELECT vec_id, (list_position(v[1:10], list_max([v[2], v[4], v[9]])) - 1)::INT AS chosen FROM e")
def restricted_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The best of the allowed tokens."""
    return _vectors(spark, folder).select("vec_id", A.argmax(A.restricted(F.slice("v", 1, 10), [1, 3, 8])).alias("chosen"))


@catalogue("minmax_255", _V + """, m AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN list_max(v) > list_min(v) THEN floor((x - list_min(v)) / (list_max(v) - list_min(v)) * 255)::INT ELSE 0 END) AS s FROM e)
SELECT vec_id, list_sum(s)::BIGINT AS total, list_max(s) AS high, s[1] AS first FROM m""")
def minmax_255(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vectors(spark, folder).select("vec_id", G.scaled_255(F.col("v")).alias("s"))
    return rows.select("vec_id", F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("s").alias("high"), F.get("s", F.lit(0)).alias("first"))


@catalogue("grey_channels", _V + """, m AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN list_max(v) > list_min(v) THEN floor((x - list_min(v)) / (list_max(v) - list_min(v)) * 255)::INT ELSE 0 END) AS s FROM e)
SELECT vec_id, 3 AS channels, (3 * list_sum(s))::BIGINT AS total FROM m""")
def grey(spark: SparkSession, folder: str) -> DataFrame:
    """One scaled channel three times."""
    rows = _vectors(spark, folder).select("vec_id", grey_channels(G.scaled_255(F.col("v"))).alias("c"))
    return rows.select("vec_id", F.size("c").alias("channels"), F.aggregate(F.flatten("c"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


_PIX = "v[least(greatest(r + {0}, 0), 7) * 8 + least(greatest(c + {1}, 0), 7) + 1]"
_GX = "(" + " + ".join(_PIX.format(i, -1) for i in (-1, 0, 1)) + ") - (" + " + ".join(_PIX.format(i, 1) for i in (-1, 0, 1)) + ")"
_GY = "(" + " + ".join(_PIX.format(-1, i) for i in (-1, 0, 1)) + ") - (" + " + ".join(_PIX.format(1, i) for i in (-1, 0, 1)) + ")"


@catalogue("prewitt", _V + f""", p AS (SELECT vec_id, k, v[k + 1] AS d, {_GX} AS gx, {_GY} AS gy FROM (SELECT vec_id, v, k, k // 8 AS r, k % 8 AS c FROM e CROSS JOIN range(64) t(k))),
m AS (SELECT vec_id, k, sqrt(gx * gx + gy * gy) AS mag FROM p), x AS (SELECT *, max(mag) OVER (PARTITION BY vec_id) AS hi, min(mag) OVER (PARTITION BY vec_id) AS lo FROM m)
SELECT vec_id, count(*) AS pixels, count(*) FILTER (WHERE floor((mag - lo) / (hi - lo) * 255) >= 128) AS strong, arg_max(k, mag)::INT AS at FROM x GROUP BY 1""")
def prewitt(spark: SparkSession, folder: str) -> DataFrame:
    """Gradient of 8 x 8 depth matrices: pixels of at least half the largest magnitude, and where it lies."""
    rows = _vectors(spark, folder).select("vec_id", F.get(depth_channels(F.col("v"), 8), F.lit(1)).alias("m"))
    return rows.select("vec_id", F.size("m").cast("long").alias("pixels"), F.size(F.filter("m", lambda x: x >= 128)).cast("long").alias("strong"), A.argmax(F.col("m")).alias("at"))


_SCALED = "CASE WHEN hi_{0} > lo_{0} THEN floor(({0} - lo_{0}) / (hi_{0} - lo_{0}) * 255) ELSE 0 END"


@catalogue("depth_channels", _V + f""", p AS (SELECT vec_id, v[k + 1] AS d, {_GX} AS gx, {_GY} AS gy FROM (SELECT vec_id, v, k, k // 8 AS r, k % 8 AS c FROM e CROSS JOIN range(64) t(k))),
m AS (SELECT vec_id, d, sqrt(gx * gx + gy * gy) AS g, atan2(gy, gx) AS a FROM p),
x AS (SELECT *, {', '.join(f"min({c}) OVER w AS lo_{c}, max({c}) OVER w AS hi_{c}" for c in 'dga')} FROM m WINDOW w AS (PARTITION BY vec_id)),
z AS (SELECT vec_id, {', '.join(f"{_SCALED.format(c)} AS s{i}" for i, c in enumerate('dga'))} FROM x)
SELECT vec_id, {', '.join(f"sum(s{i})::BIGINT AS train_{i}" for i in range(3))},
  {', '.join(f"sum(floor(greatest(0, least(255, (s{i} / 255.0::DOUBLE - {m}::DOUBLE) / {d}::DOUBLE * 255))))::BIGINT AS eval_{i}" for i, (m, d) in enumerate(zip((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))))} FROM z GROUP BY 1""")
def channels(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of the three channels, as trained on and as evaluated with."""
    rows = _vectors(spark, folder).select("vec_id", depth_channels(F.col("v"), 8).alias("a"), depth_channels(F.col("v"), 8, imagenet=True).alias("b"))
    total = lambda c, i: F.aggregate(F.get(c, F.lit(i)), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("vec_id", *[total("a", i).alias(f"train_{i}") for i in range(3)], *[total("b", i).alias(f"eval_{i}") for i in range(3)])
