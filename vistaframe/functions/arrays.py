"""Arrays as vectors, token lists and probabilities. All of it stays in the JVM.

An array of NULL gives NULL. Positions count from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it for every element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def unit(v: Column) -> Column:
    both = F.struct(v.alias("v"), F.greatest(norm(v), F.lit(1e-12)).alias("n"))
    return bound(both, lambda t: F.transform(t["v"], lambda x: x / t["n"]))


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def mean_pool(rows: Column) -> Column:
    """Element-wise mean of an array of equally long arrays."""
    width = F.size(F.get(rows, 0))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: total(F.transform(rows, lambda r: F.get(r, i).cast("double"))) / F.size(rows))


def _shifted(logits: Column, temperature: float) -> Column:
    """(logits - max) / temperature"""
    both = F.struct(logits.alias("v"), F.array_max(logits).alias("m"))
    return bound(both, lambda t: F.transform(t["v"], lambda x: (x - t["m"]) / temperature))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    e = F.transform(_shifted(logits, temperature), lambda x: F.exp(x))
    with_sum = bound(e, lambda v: F.struct(v.alias("v"), total(v).alias("s")))
    return bound(with_sum, lambda t: F.transform(t["v"], lambda x: x / t["s"]))


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    with_sum = bound(_shifted(logits, temperature), lambda v: F.struct(v.alias("v"), F.log(total(F.transform(v, lambda x: F.exp(x)))).alias("l")))
    return bound(with_sum, lambda t: F.transform(t["v"], lambda x: x - t["l"]))


def kl(p: Column, log_q: Column, log_target: bool = False) -> Column:
    """Sum of p * (log p - log q); with log_target p is taken for log p."""
    if log_target:
        return total(F.zip_with(p, log_q, lambda x, y: F.exp(x) * (x - y)))
    return total(F.zip_with(p, log_q, lambda x, y: F.when(x > 0, x * (F.log(x) - y)).otherwise(F.lit(0.0))))


def argmax(v: Column) -> Column:
    """The first position of the largest value."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def top_k(v: Column, k: int) -> Column:
    """Positions of the k largest values, ties by position."""
    ranked = F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))), asc=False)
    return F.transform(F.slice(ranked, 1, k), lambda s: -s["i"])


def padded(v: Column, length: int, fill: int = 0) -> Column:
    """Exactly length values: cut, or filled at the end."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(fill), length)), 1, length)


def masked_labels(ids: Column, pad: int = 0, by: int = -100) -> Column:
    return F.transform(ids, lambda t: F.when(t == pad, by).otherwise(t))


def find_subsequence(a: Column, b: Column) -> Column:
    """The first position at which b stands in a; NULL if nowhere or b is empty."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(a) - F.size(b), F.lit(0)))
    found = F.filter(starts, lambda i: F.slice(a, i + 1, F.size(b)) == b)
    return F.when(F.size(b) > 0, F.get(found, 0))


def masked_outside(a: Column, b: Column, by: int = -100) -> Column:
    """a with all but the first b masked; as it is if b isn't there."""
    both = F.struct(a.alias("a"), find_subsequence(a, b).alias("at"), F.size(b).alias("n"))
    kept = lambda t: F.transform(t["a"], lambda x, i: F.when((i >= t["at"]) & (i < t["at"] + t["n"]), x).otherwise(by))
    return bound(both, lambda t: F.when(t["at"].isNull(), t["a"]).otherwise(kept(t)))


def restricted(scores: Column, allowed: list[int]) -> Column:
    """Scores of tokens outside the allowed ones made minus infinity."""
    return F.transform(scores, lambda s, i: F.when(i.isin(allowed), s).otherwise(float("-inf")))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def cross_entropy(logits: Column, label: Column) -> Column:
    return -F.get(log_softmax(logits), label)


def calibrated(teacher: Column, label: Column, alpha: float = 0.8) -> Column:
    """Teacher probabilities with the label's raised and the runner-up's lowered, position by position.

    s = alpha / (1 - p_label + p_second), p'_label = 1 - s * (sum - p_label), p'_second = s * p_second."""
    parts = F.struct(
        teacher.alias("p"), total(teacher).alias("sum"), F.get(teacher, label).alias("own"), label.alias("label"),
        F.element_at(F.sort_array(teacher, asc=False), 2).alias("second"), F.get(top_k(teacher, 2), F.lit(1)).alias("at"),
    )
    scaled = lambda t: F.struct(t["p"].alias("p"), t["sum"].alias("sum"), t["own"].alias("own"), t["label"].alias("label"), t["at"].alias("at"), (alpha / (1 - t["own"] + t["second"])).alias("s"))
    return bound(
        bound(parts, scaled),
        lambda t: F.transform(t["p"], lambda p, i: F.when(i == t["label"], 1 - t["s"] * (t["sum"] - t["own"])).when(i == t["at"], t["s"] * p).otherwise(p)),
    )


def ofa_loss(teacher: Column, log_q: Column, gamma: float = 1.0) -> Column:
    """Mean of -(1 + p_max) ** gamma * log q."""
    return -F.pow(1 + F.array_max(teacher), F.lit(gamma)) * total(log_q) / F.size(log_q)


def mse(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))) / F.size(a)


def jsd(p: Column, q: Column) -> Column:
    log_m = F.zip_with(p, q, lambda x, y: F.log((x + y) / 2))
    return (kl(p, log_m) + kl(q, log_m)) / 2


def fused(a: Column, b: Column, how: str, w0: float = 0.5, w1: float = 0.5, bias: float = 0.0) -> Column:
    """Two feature vectors in one: product, sum, max, weighted, or concat."""
    if how == "concat":
        return F.concat(a, b)
    step = {"product": lambda x, y: x * y, "sum": lambda x, y: x + y, "max": F.greatest, "weighted": lambda x, y: w0 * x + w1 * y + bias}[how]
    return F.zip_with(a, b, lambda x, y: step(x.cast("double"), y.cast("double")))


def linear(v: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """A dense layer with constant weights."""
    rows = [dot(v, F.array(*[F.lit(float(x)) for x in row])) + float(b) for row, b in zip(weights, bias)]
    return F.array(*rows)
