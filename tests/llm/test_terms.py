"""Term counts against plain counting, with partitions split to disk."""

import collections
import json
import random
import re

import pyarrow as pa
import pytest

from vistaframe.llm import terms as T


def plain(records):
    occ, rec, total = collections.Counter(), collections.defaultdict(set), collections.defaultdict(set)
    for field, i, values in records:
        for v in values:
            v = (v or "").strip().lower()
            if i is None or not v:
                continue
            total[field].add(i)
            for key in [(field, "value", v)] + [(field, "word", w) for w in re.findall(r"[^\W_]+", v)]:
                occ[key] += 1
                rec[key].add(i)
    mark = lambda f, n: "rare" if n < 3 else "common" if n * 20 > len(total[f]) else None
    return {k: (occ[k], len(rec[k]), mark(k[0], len(rec[k]))) for k in occ}


@pytest.mark.parametrize("rows", [10, 1_000_000])
def test_counts(spark, rows):
    rng = random.Random(rows)
    words = ["wall", "Wall ", "night stand", "  ", "", None, "étagère", "a_b", "x1 2y", " ", "-"] + [f"w{i}" for i in range(120)]
    docs = [(i, [rng.choice(words) if rng.random() < 0.5 else "hot" for _ in range(rng.randint(0, 6))]) for i in range(300)]
    answers = [(i, rng.choice(words)) for i in range(200)] + [(None, "lost"), (5000, "None"), (5001, "none")]
    doc = lambda names: json.dumps({"objects": [{"name": n} if n is not None else {"name": 3} for n in names]})
    a = spark.createDataFrame([(i, doc(n), "clash") for i, n in docs + docs[:50]] + [(9999, "{bad", "x"), (10000, None, "x")], "annotation_id long, doc string, term string")
    q = spark.createDataFrame([(*r, "clash") for r in answers + answers[:50]], "Question_Id long, Answers string, values string")
    records = [T.names_of(a), T.values_of(q, "val_dataset.Answers", "Question_Id", "Answers", ["None"])]
    got = {(r["field"], r["unit"], r["term"]): (r["occurrences"], r["records"], r["mark"]) for r in T.marked_terms(T.term_counts(records, rows=rows)).collect()}
    assert got == plain([("annotation.name", i, n) for i, n in docs] + [("val_dataset.Answers", i, [v]) for i, v in answers if v != "None"])
    assert T.marked_terms(T.term_counts([r.limit(0) for r in records])).count() == 0


def test_radix_spill_splits_until_parts_fit(tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([rng.getrandbits(63), 7]), "f", "value", f"t{i % 50}", 1, 1) for i in range(3000)]
    columns = list(zip(*rows))
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + 100], f.type) for c, f in zip(columns, T._ARROW)], schema=T._ARROW) for k in range(0, 3000, 100)]
    spill = T.RadixSpill(str(tmp_path / "s"), rows=200, bits=2)
    out = pa.Table.from_batches(spill.aggregate(batches), schema=T._ARROW).to_pylist()
    want = collections.Counter()
    for h, f, u, t, *_ in rows:
        want[h, t] += 1
    assert {(r["hash"], r["term"]): r["occurrences"] for r in out} == dict(want)
    assert spill.splits > 4 and not list((tmp_path / "s").iterdir())


def test_long_terms_split_by_bytes(tmp_path):
    rows = [(i << 57, "f", "value", f"{i % 7}" * 20_000, 1, 1) for i in range(-60, 60)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 10]], f.type) for k, f in enumerate(T._ARROW)], schema=T._ARROW) for i in range(0, 120, 10)]
    spill = T.RadixSpill(str(tmp_path / "s"), bits=2, size=500_000)
    out = pa.Table.from_batches(spill.aggregate(batches), schema=T._ARROW)
    assert out.num_rows == 120 and spill.splits > 1


def test_records_are_counted_whole_across_batches(monkeypatch, tmp_path):
    """A record whose terms lie in several batches is one record."""
    monkeypatch.setattr(T, "COMBINE_ROWS", 5)
    rng = random.Random(2)
    rows = sorted((rng.randrange(12), rng.choice("abc")) for _ in range(200))
    schema = pa.schema([("ordinal", pa.int64()), ("hash", pa.int64()), ("field", pa.string()), ("unit", pa.string()), ("term", pa.string())])
    batches = [pa.RecordBatch.from_pylist([{"ordinal": o, "hash": ord(t), "field": "f", "unit": "word", "term": t} for o, t in rows[i : i + 7]], schema=schema) for i in range(0, 200, 7)]
    occ, rec = collections.Counter(), collections.Counter()
    for b in T._combine(f"file://{tmp_path}")(iter(batches)):
        for r in b.to_pylist():
            occ[r["term"]] += r["occurrences"]
            rec[r["term"]] += r["records"]
    assert occ == collections.Counter(t for _, t in rows) and rec == collections.Counter(t for _, t in set(rows))
    assert list(T._combine(f"file://{tmp_path}")(iter([]))) == []
