"""A sample whose categories have given shares, with floors for small ones and a report of targets that cannot be met.

Method: calibration and the pivotal method. Every record starts with the weight that its category's share asks
for and is tilted exponentially; Newton iterations on the dual
find the multipliers at which the expected counts meet two margins that overlap: the share of each type is an equation, and
each category within it has its need as a floor; a weight is at most 1. A floor or a bound that holds has a multiplier of its
own, so that the others share what is left in their type. The moments of all iterations follow from one count for each
pattern, made distributedly. What calibration gives a category less than its need is its gap, and is reported. The expected
counts are rounded, largest remainder first, and the sample is drawn with the resulting probabilities by the pivotal
method, in blocks and then among the blocks' undecided rows, so that the size of every category is exact.

At scale: one narrow row (id, category) for each record; a category is cut into blocks of ``BLOCK_ROWS`` by hash, however
many rows it has; the levels after the first have a row for each block. The driver sees one row for each target.

Defined cases
* records sent again: once. A null id: not sampled and not counted. Null, blank and missing answers: the category of their
  type with a null answer. A null type, or one without a category: in no category.
* a category with fewer rows than its need: all its rows, reported as short. No rows at all: likewise. Its type makes up for
  it; a type that cannot is made up for by the others, in proportion to their shares.
* needs of more than the sample size together: every need is met as far as the rows go, and the sample is larger.
* ties: by hash, then id; of equal remainders the lower category. An empty table: an empty sample, every target with a need
  is short.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaframe.session import cut

BLOCK_ROWS = 20_000
#: Proven bound of the table of targets, checked when it is read.
MAX_TARGETS = 10_000


def calibrate(moments: np.ndarray, counts: np.ndarray, targets: np.ndarray, floors: np.ndarray | None = None, base: np.ndarray | None = None, steps: int = 300) -> np.ndarray:
    """Probabilities of the patterns (rows of moments, held by so many records each) whose expected moments are the targets.

    Newton's method on the dual of bounded exponential tilting: a pattern's probability is base_p * exp(x_p . l), at least its
    floor by its count and at most 1 (0 without a base, as far as the floor allows). Each step is halved until the dual falls; a multiplier that no pattern between its bounds
    depends on moves by one. Targets that cannot be met leave their patterns at the bounds."""
    p = np.zeros(len(counts))
    use = counts > 0
    if not use.any() or not moments.shape[1]:
        return p
    x, n, t = moments[use].astype(float), counts[use].astype(float), targets.astype(float)
    low = np.zeros(len(n)) if floors is None else np.minimum(floors[use] / n, 1.0)
    log_low = np.log(np.maximum(low, 1e-300))
    log_base = np.zeros(len(n)) if base is None else np.log(np.maximum(base[use], 1e-300))

    def dual(lam: np.ndarray) -> float:
        z = x @ lam + log_base
        inner = np.exp(np.clip(z, log_low, 0.0))
        return float(n @ (inner + np.maximum(z, 0.0) + low * np.minimum(z - log_low, 0.0)) - t @ lam)

    held = x.T @ (n * np.exp(log_base))
    lam = np.log(np.clip(t / np.maximum(held, 1e-300), 1e-12, 1e12)) / max(1.0, x.sum(axis=1).max())
    for _ in range(steps):
        e = np.exp(np.clip(x @ lam + log_base, -700, 50))
        w = np.clip(e, low, 1.0)
        gradient = x.T @ (n * w) - t
        gradient[(lam >= 60) & (gradient < 0)] = 0.0
        gradient[(lam <= -60) & (gradient > 0)] = 0.0
        if np.abs(gradient).max() <= 1e-10 * max(1.0, np.abs(t).max()):
            break
        hessian = (x * (n * e * ((e > low) & (e < 1)))[:, None]).T @ x
        flat = np.diag(hessian) <= 1e-12
        step = np.linalg.lstsq(hessian, np.where(flat, 0.0, gradient), rcond=None)[0]
        step[flat] = np.sign(gradient[flat])
        step *= min(1.0, 3.0 / max(1e-300, np.abs(step).max()))
        before = dual(lam)
        for _ in range(40):
            after = np.clip(lam - step, -60, 60)
            if dual(after) <= before:
                break
            step /= 2
        lam = after
    p[use] = np.clip(np.exp(np.clip(x @ lam + log_base, -700, 50)), low, 1.0)
    p[p < 1e-12] = 0.0
    return p


def shared_out(shares: np.ndarray, least: np.ndarray, most: np.ndarray, total: float) -> np.ndarray:
    """Amounts in proportion to the shares, between their bounds, which add up to the total where the bounds allow it."""
    most = np.where(shares > 0, most, least)
    goal = min(max(total, least.sum()), most.sum())
    low, high = 0.0, float((most[shares > 0] / shares[shares > 0]).max(initial=0.0))
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if np.clip(shares * middle, least, most).sum() < goal else (low, middle)
    return np.clip(shares * high, least, most)


def rounded(expected: np.ndarray) -> list[int]:
    """Whole numbers with the same sum, largest remainder first, ties by position."""
    exact = np.round(expected, 6)
    size = np.floor(exact).astype(int)
    spare = int(round(float(exact.sum()))) - int(size.sum())
    order = sorted(range(len(size)), key=lambda i: (-round(float(exact[i] - size[i]), 6), i))
    for i in order[: max(0, spare)]:
        size[i] += 1
    return size.tolist()


def pivotal(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Sequential pivotal method: probabilities after all duels; 1 taken, 0 not, and at most one row between."""
    p = p.astype(float).tolist()
    if not p:
        return np.array([])
    eps, i = 1e-9, 0
    for j in range(1, len(p)):
        a, b = p[i], p[j]
        if a <= eps or a >= 1 - eps:
            i = j
            continue
        if b <= eps or b >= 1 - eps:
            continue
        s = a + b
        if s < 1 - eps:
            if u[j] * s < a:
                p[i], p[j] = s, 0.0
            else:
                p[i], p[j] = 0.0, s
                i = j
        elif s <= 1 + eps:
            win = u[j] < a
            p[i], p[j] = (1.0, 0.0) if win else (0.0, 1.0)
            i = j
        elif u[j] * (2 - s) < 1 - b:
            p[i], p[j] = 1.0, s - 1
            i = j
        else:
            p[i], p[j] = s - 1, 1.0
    out = np.array(p)
    out[out <= eps] = 0.0
    out[out >= 1 - eps] = 1.0
    return out


def _duels(seed: int, level: int, last: bool):
    """The pivotal method within one block, from the same random numbers whenever the task is run again."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "id"])
        rng = np.random.default_rng([seed, level, abs(int(pdf["category_id"].iloc[0])), int(pdf["block"].iloc[0])])
        p = pivotal(pdf["p"].to_numpy(), rng.random(len(pdf)))
        if last:
            p = np.round(p)
        return pdf.assign(p=p).loc[p > 0, ["id", "category_id", "p"]]

    return run


def read_targets(targets: DataFrame) -> list[tuple[int, str, str | None, int, int]]:
    """(category_id, type, answer in lower case without outer spaces, permille, floor), by id."""
    rows = targets.select("category_id", "question_type", "answer", "target_permille", "min_rows").where("category_id IS NOT NULL").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    found: dict[int, tuple] = {}
    for c, t, a, m, f in sorted(map(tuple, rows), key=lambda r: r[0]):
        found.setdefault(c, (c, t, a if a is None else a.strip().lower(), m or 0, f or 0))
    return list(found.values())


def categorised(df: DataFrame, targets: list[tuple], id_col: str, type_col: str, answer_col: str, missing: list[str]) -> DataFrame:
    """(id, category_id), each record once; category_id is NULL outside all categories."""
    spark = df.sparkSession
    exact, default = {}, {}
    for c, t, a, *_ in targets:
        if t is not None:
            (exact.setdefault((t, a), c) if a is not None else default.setdefault(t, c))
    answer = F.col(f"`{answer_col}`")
    answer = F.when(~answer.isin(missing), F.lower(F.regexp_replace(answer, r"(?U)^\s+|\s+$", "")))
    rows = df.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{type_col}`").alias("t"), answer.alias("a"))
    named = spark.createDataFrame([(t, a, c) for (t, a), c in exact.items()], "t string, a string, named int")
    other = spark.createDataFrame([(t, c) for t, c in default.items()], "t string, other int")
    joined = rows.join(F.broadcast(named), ["t", "a"], "left").join(F.broadcast(other), "t", "left")
    return joined.select("id", F.coalesce("named", "other").alias("category_id")).dropDuplicates(["id"])


class Plan:
    """Categories, needs and sizes of a sample; ``report`` and ``sample`` are frames."""

    def __init__(self, df: DataFrame, targets: DataFrame, id_col: str = "Question_Id", type_col: str = "Question_Type", answer_col: str = "Answers", one_in: int = 5, missing: tuple[str, ...] = ("None", "n/a", "null", "NA", "nan"), seed: int = 42) -> None:
        self.spark, self.seed, self.id_col = df.sparkSession, seed, id_col
        self.targets = read_targets(targets)
        self.rows = cut(categorised(df, self.targets, id_col, type_col, answer_col, list(missing)), "categories")
        counted = {r[0]: r[1] for r in self.rows.groupBy("category_id").count().collect()}
        self.total = sum(counted.values())
        self.n = self.total // one_in
        self.available = [counted.get(c, 0) for c, *_ in self.targets]
        permille, least = [t[3] for t in self.targets], [t[4] for t in self.targets]
        self.need = [max(m * self.n // 1000, f) for m, f in zip(permille, least)]
        types = sorted({t[1] for t in self.targets if t[1] is not None})
        x = np.array([[float(t[1] == k) for k in types] for t in self.targets]).reshape(len(self.targets), len(types))
        available, floors = np.array(self.available, dtype=float), np.minimum(self.need, self.available).astype(float)
        asked = np.array(permille, dtype=float)
        margins = shared_out(x.T @ asked, x.T @ floors, x.T @ np.where(asked > 0, available, floors), float(self.n)) if types else np.array([])
        #: Expected counts after calibration, and what they lack.
        self.expected = np.round(calibrate(x, available, margins, floors, asked / np.maximum(available, 1.0)) * available, 6)
        self.gap = np.round(np.maximum(np.array(self.need, dtype=float) - self.expected, 0.0), 4)
        self.size = rounded(self.expected)
        self.p = [s / a if a else 0.0 for s, a in zip(self.size, self.available)]

    def report(self) -> DataFrame:
        """(category_id, need, available, expected, drawn, target_share, share, gap, short): share is that of the sample."""
        drawn = max(1, sum(self.size))
        rows = [
            (c, d, a, round(float(e), 4), s, m / 1000, round(s / drawn, 6), float(g), bool(g > 0))
            for (c, _, _, m, _), d, a, e, s, g in zip(self.targets, self.need, self.available, self.expected, self.size, self.gap)
        ]
        return self.spark.createDataFrame(rows, "category_id int, need long, available long, expected double, drawn long, target_share double, share double, gap double, short boolean")

    def sample(self) -> DataFrame:
        """(<id>, category_id) of the sample."""
        rows = [(c, float(p), int(-(-a // BLOCK_ROWS))) for (c, *_), p, a in zip(self.targets, self.p, self.available) if p > 0]
        chances = F.broadcast(self.spark.createDataFrame(rows, "category_id int, p double, blocks int"))
        kind = self.rows.schema["id"].dataType.simpleString()
        schema = f"id {kind}, category_id int, p double"
        left = self.rows.join(chances, "category_id")
        taken = left.where("p >= 1").select("id", "category_id")
        left, blocks, level = left.where("p < 1"), max((b for _, p, b in rows if p < 1), default=0), 0
        seed = self.seed

        while blocks:
            last = blocks == 1

            h = F.xxhash64("id", F.lit(seed), F.lit(level))
            keyed = left.withColumn("h", h).withColumn("block", F.pmod(F.xxhash64("h"), F.greatest("blocks", F.lit(1)).cast("long")))
            done = cut(keyed.groupBy("category_id", "block").applyInPandas(_duels(seed, level, last), schema), f"pivotal-{level}")
            taken = taken.unionAll(done.where("p = 1").select("id", "category_id"))
            # one row a block is undecided; the next level has as many rows as this one had blocks
            left = done.where("p < 1").join(chances.select("category_id", F.ceil(F.col("blocks") / F.lit(float(BLOCK_ROWS) ** (level + 1))).cast("int").alias("blocks")), "category_id")
            blocks, level = (0 if last else -(-blocks // BLOCK_ROWS)), level + 1
        return taken.select(F.col("id").alias(self.id_col), "category_id")
