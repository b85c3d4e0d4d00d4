"""Ids, balance, splits, vocabularies, scores, files and streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from vistaframe.operators import curation as C
from vistaframe.operators import metrics as M
from vistaframe.operators import ranking as R
from vistaframe.operators import vocab as V
from vistaframe.operators.vectors import contrastive_loss
from vistaframe.sources import files
from vistaframe.sources.tables import once
from vistaframe.streaming import incremental


def test_sequential_ids_over_partitions(spark):
    df = spark.range(5000).repartition(7).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(100_003)))
    got = [(r["n"], r["k"], r["id"]) for r in R.sequential_ids(df, ["k", "id"], "n").collect()]
    assert [g[0] for g in sorted(got)] == list(range(1, 5001))
    assert [g[1:] for g in sorted(got)] == sorted(g[1:] for g in got)
    assert R.sequential_ids(df.limit(0), ["k"], "n").count() == 0


def test_prefix_batches_and_cap(spark):
    df = spark.range(90)
    assert R.prefix(df, ["id"], 0.7).count() == 62
    b = R.batches(df, ["id"], 32, drop_last=True).groupBy("batch_id").count().collect()
    assert sorted(map(tuple, b)) == [(0, 32), (1, 32)]
    capped = R.capped(df.withColumn("k", F.lit("hot")), ["k"], ["id"], 10)
    assert sorted(r["id"] for r in capped.collect()) == list(range(10))


def test_split_bounds_are_those_of_doubles(spark):
    split = {r[0]: r[1] for r in C.split_721(spark.range(90), ["id"]).groupBy("split").count().collect()}
    assert split == {"train": 62, "test": 19, "validation": 9}


def test_balance_remainder_and_odd(spark):
    rows = [(i, f"img{i:02d}", t) for i, t in enumerate(["A", "B", "C"] * 4) if i < 10]
    df = spark.createDataFrame(rows, "Question_Id int, Image_Path string, Question_Type string")
    out = sorted(map(tuple, C.balance_by_type(df).collect()))
    chunk = {"A": range(0, 3), "B": range(3, 6), "C": range(6, 9)}
    assert out == [r for r in rows if r[0] in chunk[r[2]]]
    seven = [(i, "Yes/No", "Yes" if i < 4 else "no") for i in range(7)] + [(9, "Count", "one"), (10, None, "x")]
    yn = C.balance_yes_no(spark.createDataFrame(seven, "Question_Id int, Question_Type string, Answers string"))
    kinds = [(r["Question_Type"], r["Answers"].lower()) for r in yn.collect()]
    assert sorted(kinds, key=str) == sorted([("Yes/No", "yes"), ("Yes/No", "no"), ("Count", "one"), (None, "x")], key=str)


def test_union_leaves_out_frames_without_columns(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3, 4, 5)], "y int, x int, z int")
    assert sorted(map(tuple, C.union_required([a, b, a.drop("x")], ["x", "y"]).collect()), key=str) == [(1, 2, None), (4, 3, 5)]
    with pytest.raises(ValueError):
        C.union_required([a.drop("x")], ["x"])


def test_vocabulary_and_encoding(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, "c a"), (3, None), (4, "z " * 20)], "k int, t string")
    tokens = F.filter(F.split("t", " "), lambda x: x != "")
    vocab = V.word_vocabulary(df.where("k < 3"), "k", tokens)
    assert {r[0]: r[1] for r in vocab.collect()} == {"b": 2, "a": 3, "c": 4}
    ids = {r[0]: r[1] for r in V.encoded(df, "k", tokens, vocab).collect()}
    assert ids[1] == [2, 3, 2] + [0] * 12 and ids[3] == [0] * 15 and ids[4] == [1] * 15
    classes = V.class_ids(df, F.col("t"), V.answer_vocabulary(df, "k", F.col("t"))).collect()
    assert sorted((r["k"], r["class_id"]) for r in classes) == [(1, 0), (2, 1), (3, 0), (4, 2)]


def test_accuracy_counts_missing_as_wrong_and_ignores_order(spark):
    df = spark.createDataFrame([("and left above", "above and left"), (None, "x"), ("x", None), ("Lamp", "lamp")], "p string, r string")
    row = M.accuracy(df, [], M.matches(F.col("p"), F.col("r"))).first()
    assert (row["n"], row["matched"], row["accuracy"]) == (4, 2, 0.5)
    empty = M.accuracy(df.limit(0), [], M.matches(F.col("p"), F.col("r"))).first()
    assert empty["accuracy"] == 0.0


def test_overall_from_published_categories(spark):
    """Published accuracies of six categories give the published overall accuracy."""
    rows = [(340, 0.4588), (340, 0.6029), (330, 0.3667), (337, 0.3383), (331, 0.2296), (180, 0.9333)]
    per = spark.createDataFrame([("f", n, a) for n, a in rows], "file string, n int, accuracy double")
    out = M.overall(per, ["file"]).first()
    assert out["n"] == 1858 and abs(out["accuracy"] - 0.4521) < 1e-4


def test_intervals(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    r = M.mean_interval(df, [], F.col("x")).first()
    margin = 1.959963984540054 * math.sqrt(5 / 3) / 2
    assert abs(r["low"] - (2.5 - margin)) < 1e-12 and abs(r["high"] - (2.5 + margin)) < 1e-12
    p = M.proportion_interval(df, [], F.col("x") > 0).first()
    assert (p["p"], p["low"], p["high"]) == (1.0, 1.0, 1.0)


def test_next_available_wraps_and_gives_up(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, None), ("b", 1, None)], "g string, o int, v int")
    got = {(r["g"], r["o"]): r["available"] for r in R.next_available(df, "o", "v", "g").collect()}
    assert got == {("a", 1): 5, ("a", 2): 5, ("a", 3): 5, ("b", 1): None}


def test_early_stop(spark):
    losses = [5.0, 4.0, 4.0, 4.5, 3.0, 1.0]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(losses)], "run string, epoch int, loss double")
    assert tuple(R.early_stop(df, "run", "epoch", "loss", 2).first()) == ("r", 4.0, 1, 3)


def test_contrastive_batch_of_one_is_zero(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 2, [1.0, 0.0]), (1, 3, [0.0, 1.0])], "b int, k int, v array<double>")
    got = {r["b"]: r["loss"] for r in contrastive_loss(df, "b", "k", "v", "v").collect()}
    assert got[0] == 0.0 and 0 < got[1] < 1e-5


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" x \n\ny\n")
    (tmp_path / "b.txt").write_text("1\n2")
    a, b = files.read_lines(spark, str(tmp_path / "a.txt")), files.read_lines(spark, str(tmp_path / "b.txt"))
    assert sorted(map(tuple, a.collect())) == [(0, "x"), (1, ""), (2, "y")]
    assert sorted(map(tuple, files.zip_lines({"p": a, "q": b}).collect())) == [(0, "x", "1"), (1, "", "2")]
    (tmp_path / "t.csv").write_text('A,B\n"x, ""y""\nz",None\nnone,n/a\n')
    rows = [(r["A"], r["B"], r["File_Name"]) for r in files.read_csv(spark, str(tmp_path / "t.csv"), "A string, B string").collect()]
    assert rows == [('x, "y"\nz', None, "t.csv"), ("none", None, "t.csv")]
    for n in ("word2idx", "idx2word", "ans2idx", "idx2ans", "config"):
        (tmp_path / f"{n}.json").write_text(json.dumps({"0": "<PAD>"} if n.startswith("idx") else {"max_len": 15}))
    vocab = files.read_vocabulary(spark, str(tmp_path))
    assert tuple(vocab["idx2word"].first()) == (0, "<PAD>") and tuple(vocab["config"].first()) == ("max_len", 15)
    (tmp_path / "config.json").unlink()
    with pytest.raises(FileNotFoundError):
        files.read_vocabulary(spark, str(tmp_path))
    assert [r[0].rsplit("/", 1)[1] for r in files.list_files(spark, str(tmp_path), ".txt").collect()] == ["a.txt", "b.txt"]
    assert files.best_checkpoint(spark.createDataFrame([("a/val_loss=0.5.ckpt",), ("b",), ("c/val_loss=0.1.ckpt",)], "p string"), F.col("p")).first()["path"] == "c/val_loss=0.1.ckpt"
    assert files.row_at(spark.range(3), "id", 2).first()[0] == 2
    with pytest.raises(IndexError):
        files.row_at(spark.range(3), "id", 3)
    assert sorted(r[0] for r in files.flatten_cells(spark.createDataFrame([("a", None), ("b", "c")], "x string, y string")).collect()) == ["a", "b", "c"]


def test_vocabulary_is_read_as_it_was_written(spark, tmp_path):
    words = spark.createDataFrame([("wall", 2), ('a "b"', 3), ("été", 4)], "token string, id long")
    answers = spark.createDataFrame([("yes", 0), ("no", 1)], "token string, id long")
    files.write_vocabulary(words, answers, f"file://{tmp_path}/v", {"max_len": 15})
    got = {n: sorted(map(tuple, df.collect())) for n, df in files.read_vocabulary(spark, f"file://{tmp_path}/v").items()}
    assert got == {"word2idx": [('a "b"', 3), ("wall", 2), ("été", 4)], "idx2word": [(2, "wall"), (3, 'a "b"'), (4, "été")], "ans2idx": [("no", 1), ("yes", 0)], "idx2ans": [(0, "yes"), (1, "no")], "config": [("max_len", 15)]}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", 'x, "y"'), (0, "a", None)], "idx int, path string, note string")
    files.write_lines(df, f"file://{tmp_path}/lines")
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/lines").collect()] == ["a", "b"]
    files.write_csv(df, f"file://{tmp_path}/csv", ["idx"])
    assert [tuple(r) for r in spark.read.schema(df.schema).option("header", True).option("escape", '"').csv(f"file://{tmp_path}/csv").orderBy("idx").collect()] == [(0, "a", None), (1, "b", 'x, "y"')]
    assert files.as_base64(spark.createDataFrame([(bytearray(b"abc"),)], "content binary")).first()[0] == "YWJj"


def test_question_pairs(spark):
    a = spark.createDataFrame([([(1, 10), (2, 11)],)], "annotations array<struct<image_id:int,question_id:int>>")
    q = spark.createDataFrame([([(10, "x"), (11, "y")],)], "questions array<struct<question_id:int,question:string>>")
    assert sorted((r["image_id"], r["question"]) for r in files.question_pairs(a, q).collect()) == [(1, "x"), (2, "y")]
    with pytest.raises(Exception, match="no question 11"):
        files.question_pairs(a, q.select(F.slice("questions", 1, 1).alias("questions"))).collect()


def test_once_and_anti(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b")], "k int, v string")
    assert once(df, "k").count() == 2
    done = spark.createDataFrame([("x", 1.0)], "File_Name string, a double")
    fresh = spark.createDataFrame([("x", 2.0), ("y", 3.0)], "File_Name string, a double")
    assert sorted(map(tuple, incremental.merge_results(done, fresh).collect())) == [("x", 1.0), ("y", 3.0)]
    assert sorted(map(tuple, incremental.merge_results(done, fresh.limit(0)).collect())) == [("x", 1.0)]


def test_stream_scores_each_file_once(spark, tmp_path):
    schema = "Question_Type string, Answers string, Model_Answer string"
    def add(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/tmp-{name}")
        part = next((tmp_path / f"tmp-{name}").glob("*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / f"{name}.parquet")

    run = lambda: incremental.score_new_files(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/chk")
    add("a", [("Count", "one", "one"), ("Count", "two", "one")])
    run()
    add("b", [("Count", "one", "one")])
    run()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r["File_Name"], r["Simple_Accuracy"]) for r in rows) == [("a.parquet", 0.5), ("b.parquet", 1.0)]


def test_small_operators(spark):
    df = spark.createDataFrame([("s", 0, "wall"), ("s", 1, "lamp"), ("t", 0, "lamp")], "scene string, obj int, name string")
    assert sorted(map(tuple, C.without_objects(df, "scene", "obj", df.where("name = 'wall'")).collect())) == [("s", 1, "lamp"), ("t", 0, "lamp")]
    listing = spark.createDataFrame([("a",), ("a",)], "path string")
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, p string")
    assert [r["k"] for r in C.with_files(rows, listing, "p").collect()] == [1]
    capped = C.capped_names(df, "name", "scene", {"lamp": 1})
    assert sorted(map(tuple, capped.collect())) == [("s", 0, "wall"), ("s", 1, "lamp")] and C.capped_names(df, "name", "scene").count() == 3
    two = spark.createDataFrame([(1, "x"), (2, "y")], "k int, r string")
    assert C.zipped(rows.limit(2), two, "k").count() == 2
    with pytest.raises(ValueError):
        C.zipped(rows, two, "k")
    keys = spark.range(1).select(C.keys_of(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2), F.lit("c"), F.lit(1)), F.lit(1)).alias("k")).first()[0]
    assert sorted(keys) == ["a", "c"]


def test_shared_folder_is_the_sessions(spark):
    from vistaframe import session

    named = spark.conf.get("spark.checkpoint.dir", None)
    df = session.cut(spark.range(10))
    assert df.count() == 10 and session.shared_folder(spark).split(":")[-1].strip("/") in df.inputFiles()[0]
    assert spark.conf.get("spark.checkpoint.dir") == (named or session.shared_folder(spark))
