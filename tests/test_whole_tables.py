"""Queries read their whole tables: rows that SQL's regular expressions or number formats would leave out."""

import glob
import hashlib
import os
import re

import pytest

from vistaframe.functions import text as T
from vistaframe.plans import registry

FOLDER = os.environ.get("SQL_TEST_DIR", "/root/testdata/sf0.001")

QA = "Question_Id long, IDs long, Questions string, Answers string, Image_Path string, Depth_Path string, Question_Type string"


@pytest.fixture
def ran(spark, tmp_path):
    """Runs a query on tables given as (rows, schema)."""

    def run(name, **tables):
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
        return registry.queries()[name](spark, str(tmp_path)).collect()

    return run


def test_after_marker_reads_every_text(ran):
    texts = ["Ein Stück, 3 Wände", "user assistant Él mide 12 m assistant x", "7", "plain Text", "", None]
    got = {r["doc_id"]: r["said"] for r in ran("after_marker", documents=(list(enumerate(texts)), "doc_id long, text string"))}
    assert got == {0: "ein stück, three wände", 1: "él mide twelve m", 2: "seven", 3: "plain text", 4: ""}


ROWS = [
    (1, "Is there any café hair?", "yes", "é.jpg", "Yes/No"), (2, "Is there any red étagère?", "Yes", "a.jpg", "Yes/No"), (3, "Is there no lamp？", "no", "b.jpg", "Yes/No"), (4, "Is there no ALL?", "NO", "b.jpg", "Yes/No"),
    (5, "What’s closest to the wáll?", "grey touchs", "c.jpg", "Closest"), (6, "Is étéhair there?", "éall", "d.jpg", "Closest"), (7, "Ïs all of it ots?", "mind fridge", "d.jpg", "Closest"), (8, "What – wall12?", "ß", "é.jpg", "Closest"),
    (9, "Où, so far?", "I think", "f.jpg", "Closest"), (10, None, "cháir", "a.jpg", None), (11, "Is it red？", None, None, "Yes/No"), (12, "lámp", "all", "é.jpg", "Closest"),
]


def fixed(text, *repairs):
    for word, by in [*repairs, *T.REPAIRS] if text is not None else []:
        text = re.sub(rf"\b{word}\b", by, text, flags=re.I)
    return text


def qa(rows):
    return [(i, i, q, a, image, None, kind) for i, q, a, image, kind in rows], QA


REPAIRED = [(i, fixed(q, *T.QUESTION_REPAIRS), fixed(a, ("grey", "gray"), *T.ANSWER_REPAIRS), image, kind) for i, q, a, image, kind in ROWS]


def says(pattern, *texts):
    return any(re.search(pattern, t, re.I) for t in texts if t is not None)


NOISE = r"wall\d+|^i think$"


def test_repairs_read_every_row(ran):
    got = ran("regex_repair", train_dataset=qa(ROWS[:4]), val_dataset=qa(ROWS[4:8]), test_dataset=qa(ROWS[8:]))
    md5 = lambda q: None if q is None else hashlib.md5(q.encode()).hexdigest()
    assert sorted(map(tuple, got)) == [(i, md5(q), a) for i, q, a, _, _ in REPAIRED]


def test_patterns_read_every_row(ran):
    got = ran("drop_patterns", train_dataset=qa(ROWS[:4]), val_dataset=qa(ROWS[4:8]), test_dataset=qa(ROWS[8:]))
    want = {kind: (sum(r[4] == kind for r in ROWS), sum(r[4] == kind and says(r"\b(all|alls)\b", r[1], r[2]) for r in ROWS), sum(r[4] == kind and says(NOISE, r[1], r[2]) for r in ROWS)) for kind in {r[4] for r in ROWS}}
    assert {r["Question_Type"]: (r["n"], r["says_all"], r["noise"]) for r in got} == want


def test_curation_reads_every_row(ran):
    rows = [r for r in REPAIRED if not says(NOISE, r[1], r[2])]
    kinds = sorted({r[4] for r in rows if r[4]}, key=lambda k: min(r[0] for r in rows if r[4] == k))
    images = sorted({r[3] for r in rows if r[3]}, key=str.encode)
    k = len(images) // len(kinds)
    rows = [r for r in rows if r[3] and r[4] and images.index(r[3]) // k == kinds.index(r[4])]
    asked = [r for r in rows if r[4] == "Yes/No"]
    order = sorted(asked, key=lambda r: hashlib.md5(f"{r[0]}|42".encode()).hexdigest())
    kept = {r[0] for w in ("yes", "no") for r in [x for x in order if x[2] and x[2].lower() == w][: len(asked) // 2 // 2]}
    rows = [r for r in rows if r[4] != "Yes/No" or r[0] in kept]
    got = ran("curated", val_dataset=qa(ROWS))
    assert rows and sorted(map(tuple, got)) == [(n, kind, q, a) for n, (_, q, a, _, kind) in enumerate(rows, 1)]


ASKED = ["What’s the éclair？", "How many\u00a0lámps are there?", "How many étagères are there? How many lamps are there?", None, "the LÁMPS, what’s", *["Is there no lamp?"] * 12, "Ünder the\u3000wall"]
QUESTIONS = [(i, q) for i, q in enumerate(ASKED, 1)]


def words(text):
    return re.sub("[?.,]", "", text.lower()).split()


def test_vocabulary_and_ids_read_every_question(ran):
    vocabulary = {}
    for _, q in QUESTIONS:
        for w in words(q) if q is not None else []:
            vocabulary.setdefault(w, len(vocabulary) + 2)
    tables = {"val_dataset": (QUESTIONS, "Question_Id long, Questions string")}
    assert {r["token"]: r["id"] for r in ran("word_vocabulary", **tables)} == vocabulary
    want = {i: " ".join(map(str, ([vocabulary[w] for w in words(q)] + [0] * 15)[:15])) for i, q in QUESTIONS if q is not None}
    assert {r["Question_Id"]: r["ids"] for r in ran("encode_pad", **tables)} == want


def test_answers_are_read_whole(ran):
    answers = ["Café  Chair!", "papier-mâché\u00a0mask", "gráy", "’tis", None, "", "lamp"]
    tables = {"val_dataset": ([(a,) for a in answers], "Answers string")}
    given = [a for a in answers if a is not None]
    assert {r["a"] for r in ran("normalize_answer", **tables)} == {" ".join(re.sub(r"[^\w\s]", "", a.lower()).split()) for a in given}
    assert {r["token"] for r in ran("distinct_tokens", **tables)} == {t for a in given for t in a.split()}


def test_nouns_are_read_whole(ran):
    got = ran("noun_frequency", train_dataset=(QUESTIONS, "Question_Id long, Questions string"))
    assert {r["noun"]: r["n"] for r in got} == {"étagères": 1, "lamps": 1}


def test_batches_are_cut_from_every_question(ran):
    rows = [(i, len(words(q))) for i, q in QUESTIONS if q is not None]
    batches = [[n for _, n in rows[k : k + 16]] for k in range(0, len(rows), 16)]
    got = ran("pad_batches", test_dataset=(QUESTIONS, "Question_Id long, Questions string"))
    assert sorted(map(tuple, got)) == [(k, len(b), max(b), max(b) * len(b) - sum(b)) for k, b in enumerate(batches)] and len(got) == 2


@pytest.mark.parametrize("values,least", [([0.5, 0.0004, 12345678.0, None], "0.0004"), ([0.5, 0.0, 0.0004], "0.0"), ([2.0, 0.25], "0.25"), ([12345678.0], "12345678.0")])
def test_the_least_loss_is_read(ran, values, least):
    got = ran("min_val_loss", events=([(v,) for v in values], "value double"))
    assert [tuple(r) for r in got] == [(f"run/val_loss={least}.ckpt", float(least))]


def test_folders_of_every_scene(ran):
    said = {
        "SUNRGBD/a/b/c/image/1.jpg": "a/b/c", "/mnt/store/SUNRGBD/a/b/c/image/1.jpg": "a/b/c", "./SUNRGBD/a/b/c/image/1.jpg": "a/b/c", "SUNRGBD\\a\\b\\c\\image\\1.jpg": "a/b/c", " SUNRGBD/a/b/c/image/1.jpg ": "a/b/c",
        "SUNRGBD/SUNRGBD/a/image/1.jpg": "SUNRGBD/a", "sunrgbd/a/b/c/image/1.jpg": None, "a/b/c/image/1.jpg": None, None: None, "SUNRGBD/image/1.jpg": "",
    }
    got = ran("relative_paths", scene=(list(enumerate(said)), "scene_idx long, rgb_path string"))
    assert [r["folder"] for r in sorted(got, key=lambda r: r["scene_idx"])] == list(said.values())


#: Queries whose rows don't depend on other rows, so that what their SQL gives for the rows it reads must be among them.
BY_ROW = ["after_marker", "regex_repair", "normalize_answer", "distinct_tokens", "relative_paths"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", BY_ROW)
def test_rows_of_the_sql_are_among_them(spark, name):
    import duckdb

    from verify import plain

    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cur = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    got = {tuple(plain(x) for x in r) for r in registry.queries()[name](spark, FOLDER).select(*columns).collect()}
    want = {tuple(plain(x) for x in r) for r in cur.fetchall()}
    assert want and want <= got
