"""Calibration against closed forms, the pivotal method against its probabilities, samples against their sizes."""

import numpy as np
import pytest

from vistaframe.llm import proportions as P


def test_calibration_of_one_margin_is_the_ratio():
    p = P.calibrate(np.eye(3), np.array([100, 50, 0]), np.array([20.0, 50.0, 3.0]))
    assert np.allclose(p, [0.2, 1.0, 0.0])


def test_calibration_of_two_margins():
    """Two rows and two columns: expected margins are met, and the weights are a product of a row and a column factor."""
    x = np.array([[1, 0, 1, 0], [1, 0, 0, 1], [0, 1, 1, 0], [0, 1, 0, 1]], dtype=float)
    n, t = np.array([400, 100, 200, 300]), np.array([60.0, 40.0, 70.0, 30.0])
    p = P.calibrate(x, n, t)
    assert np.allclose(x.T @ (n * p), t, rtol=1e-6)
    assert np.isclose(p[0] * p[3], p[1] * p[2])


def test_calibration_stops_at_one():
    p = P.calibrate(np.array([[1.0], [1.0]]), np.array([10, 10]), np.array([30.0]))
    assert np.allclose(p, [1, 1])


def test_pivotal_keeps_sums_and_probabilities():
    rng = np.random.default_rng(0)
    p = np.array([0.2, 0.7, 0.5, 0.35, 0.25, 1.0, 0.0])
    taken = np.zeros(len(p))
    for _ in range(4000):
        out = P.pivotal(p, rng.random(len(p)))
        assert abs(out.sum() - p.sum()) < 1e-9 and ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 1
        taken += np.round(out)
    assert np.allclose(taken / 4000, p, atol=0.035)
    assert P.pivotal(np.array([]), np.array([])).size == 0
    assert np.allclose(P.pivotal(np.full(10, 0.3), rng.random(10)).sum(), 3)


def test_calibration_with_floors():
    """Two types with two patterns each: what the floors and the bound of 1 leave is shared at one weight within the type."""
    x = np.array([[1, 0], [1, 0], [0, 1], [0, 1]], dtype=float)
    n = np.array([100, 20, 50, 10])
    p = P.calibrate(x, n, np.array([60.0, 40.0]), np.array([0, 15.0, 0, 10.0]))
    assert np.allclose(n * p, [45, 15, 30, 10])
    p = P.calibrate(x, n, np.array([118.0, 12.0]), np.array([0, 0, 2.0, 10.0]))
    assert np.allclose(n * p, [118 * 100 / 120, 118 * 20 / 120, 2, 10])
    p = P.calibrate(x, n, np.array([500.0, 5.0]), np.array([0, 0, 2.0, 10.0]))  # cannot be met: the bounds
    assert np.allclose(n * p, [100, 20, 2, 10])


def test_calibration_against_plain_search():
    """Random types and floors: the weights equal those of a bisection in each type."""
    rng = np.random.default_rng(7)
    for _ in range(60):
        kind = rng.integers(0, 4, 12)
        n = rng.integers(1, 1000, 12)
        floors = np.floor(n * rng.random(12) * rng.integers(0, 2, 12))
        x = (kind[:, None] == np.arange(4)).astype(float)
        t = np.clip(rng.random(4) * (x.T @ n), x.T @ floors, x.T @ n)
        base = rng.random(12) + 0.01
        p = P.calibrate(x, n, t, floors, base)
        for k in range(4):
            own = kind == k
            low, high = 0.0, 200.0
            for _ in range(100):
                w = (low + high) / 2
                low, high = (w, high) if np.clip(n[own] * base[own] * w, floors[own], n[own]).sum() < t[k] else (low, w)
            assert np.allclose(n[own] * p[own], np.clip(n[own] * base[own] * high, floors[own], n[own]), atol=1e-4)


def test_shares():
    out = P.shared_out(np.array([500.0, 500.0]), np.zeros(2), np.array([100.0, 2.0]), 10)
    assert np.allclose(out, [8, 2])
    assert np.allclose(P.shared_out(np.array([900.0, 100.0]), np.array([0.0, 4.0]), np.array([100.0, 100.0]), 10), [6, 4])
    assert np.allclose(P.shared_out(np.array([1.0, 0.0]), np.array([0.0, 3.0]), np.array([5.0, 9.0]), 100), [5, 3])
    assert P.rounded(np.array([1.5, 2.5, 1.0])) == [2, 2, 1] and P.rounded(np.array([0.0, 3.0])) == [0, 3] and P.rounded(np.array([])) == []


TARGETS = [(1, "A", None, 500, 5), (2, "A", " Red", 300, 5), (3, "B", None, 200, 5), (4, "C", "x", 10, 3)]


def plan(spark, rows):
    df = spark.createDataFrame(rows, "Question_Id long, Question_Type string, Answers string, category_id string")
    targets = spark.createDataFrame(TARGETS, "category_id int, question_type string, answer string, target_permille int, min_rows int")
    return P.Plan(df, targets)


@pytest.mark.parametrize("block", [7, 20_000])
def test_sample(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK_ROWS", block)
    rows = [(i, "A", "blue", "x") for i in range(600)] + [(1000 + i, "A", ["RED ", "red"][i % 2], "x") for i in range(30)] + [(2000 + i, "B", ["None", None, "y", " "][i % 4], "x") for i in range(300)]
    rows += [(3000 + i, None, "z", "x") for i in range(70)] + [(None, "A", "blue", "x")]
    p = plan(spark, rows + rows[:200])
    assert (p.total, p.n) == (1000, 200)
    rows_of = {r["category_id"]: r for r in p.report().collect()}
    report = {c: (r["need"], r["available"], r["drawn"], r["short"]) for c, r in rows_of.items()}
    assert rows_of[2]["gap"] == 30 and rows_of[4]["gap"] == 3 and rows_of[1]["gap"] == rows_of[3]["gap"] == 0
    # types A and B share the 200 as 800 to 200; A makes up for its short category
    assert abs(rows_of[1]["expected"] + rows_of[2]["expected"] - 160) < 1e-4 and abs(rows_of[3]["expected"] - 40) < 1e-4
    assert rows_of[1]["share"] == rows_of[1]["drawn"] / 200 and rows_of[1]["target_share"] == 0.5
    assert report[2] == (60, 30, 30, True) and report[4] == (3, 0, 0, True) and not report[1][3] and not report[3][3]
    drawn = p.sample().collect()
    assert len(drawn) == len({r["Question_Id"] for r in drawn}) == 200
    for c in (1, 2, 3, 4):
        assert sum(r["category_id"] == c for r in drawn) == report[c][2]
    kind = {i: (1 if t == "A" and "red" not in a.lower() else 2) if t == "A" else 3 for i, t, a, _ in rows if t and i}
    assert all(kind[r["Question_Id"]] == r["category_id"] for r in drawn)
    assert sorted(drawn) == sorted(plan(spark, rows).sample().collect())


def test_empty_table(spark):
    p = plan(spark, [(None, None, None, None)])
    assert {r["category_id"] for r in p.report().collect() if r["short"]} == {1, 2, 3, 4} and p.sample().count() == 0
