"""Column functions on the edge cases of the reference."""

import math

import pytest
from pyspark.sql import functions as F

from vistaframe.functions import arrays as A
from vistaframe.functions import geometry as G
from vistaframe.functions import numbers as N
from vistaframe.functions import slots
from vistaframe.functions import text as T
from vistaframe.operators import imaging


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()[0]


def s(v):
    return F.lit(v).cast("string")


def arr(v, kind="double"):
    return F.array(*[F.lit(x).cast(kind) for x in v]) if v else F.expr("array()").cast(f"array<{kind}>")


@pytest.mark.parametrize("x,y,area", [([0, 4, 4, 0], [0, 0, 3, 3], 12.0), ([0, 4, 4], [0, 0, 3], 0.0), ([0, 1, 0, 1], [0, 1, 1, 0], 0.0), ([], [], 0.0), ([0, 4, 4, 0, 9], [0, 0, 3, 3], 12.0)])
def test_area(spark, x, y, area):
    assert one(spark, G.polygon_area(arr(x), arr(y))) == area


def test_centroid_is_of_the_vertices(spark):
    assert tuple(one(spark, G.centroid(arr([0, 3]), arr([0, 1, 99])))) == (1.5, 0.5)
    assert one(spark, G.centroid(arr([]), arr([]))) is None


@pytest.mark.parametrize(
    "theta,word",
    [(0, "right"), (0.009, "right"), (0.011, "left and above"), (-0.011, "left and under"), (math.pi, "left"), (-math.pi, "left"), (math.pi - 0.02, "right and above"), (math.pi / 2, "above"), (-math.pi / 2, "under"), (1.0, "left and above"), (-2.5, "right and under")],
)
def test_direction(spark, theta, word):
    assert one(spark, G.direction(F.lit(float(theta)))) == word


def test_flat_pictures_are_zero(spark):
    assert one(spark, G.scaled_255(arr([7, 7, 7]))) == [0, 0, 0]
    assert one(spark, G.scaled_255(arr([0, 5, 10]))) == [0, 127, 255]
    assert one(spark, G.scaled_16_to_8(arr([0, 300, 65535]))) == [0, 1, 255]
    flat = spark.range(1).select(imaging.depth_channels(arr([3.0] * 9), 3).alias("c")).first()[0]
    assert flat == [[0] * 9] * 3
    assert spark.range(1).select(imaging.depth_channels(arr([3.0] * 8), 3).alias("c")).first()[0] is None


@pytest.mark.parametrize("n,words", [(0, "zero"), (13, "thirteen"), (40, "forty"), (99, "ninety-nine"), (100, "one hundred"), (215, "two hundred and fifteen"), (1000, "one thousand"), (1001, "one thousand and one"), (12345, "twelve thousand, three hundred and forty-five"), (1_000_000, "1000000"), (-3, "-3"), (None, None)])
def test_number_words(spark, n, words):
    assert one(spark, N.number_words(F.lit(n).cast("bigint"))) == words


@pytest.mark.parametrize("text,out", [("chair12", "chair"), ("tv2a", "tv2a"), ("12", "twelve"), ("TrashCan.", "trash can"), ("2 trashcan7", "two trashcan"), ("", ""), (None, None)])
def test_processed_name(spark, text, out):
    assert one(spark, T.processed_name(s(text), [("trashcan", "trash can")])) == out


@pytest.mark.parametrize("text,out", [("Grey wall", "Grey wall"), ("touchs", "couches"), ("what?", "what?"), ("my hair is so far", "my chair is sofa"), ("étéhair", "étéhair"), (None, None)])
def test_repairs(spark, text, out):
    assert one(spark, T.repaired(s(text))) == out


def test_gray_red_and_noise(spark):
    assert one(spark, T.gray(s("Grey wall"))) == "gray wall"
    assert one(spark, T.repaired(s("Is the red chair?"), T.QUESTION_REPAIRS)) == "Is the bed chair?"
    noise = [one(spark, T.is_noise(s(t))) for t in ("wall40", "I think", "i think so", "hall", None)]
    assert noise == [True, True, False, False, False]
    assert [one(spark, T.says_all(s(a), s(b))) for a, b in (("hall", None), ("all in", None), (None, "ALLS"))] == [False, True, True]


def test_paths_and_prompts(spark):
    assert one(spark, T.without_first(s("SUNRGBD/a/SUNRGBD"), "SUNRGBD")) == "/a/SUNRGBD"
    assert one(spark, T.image_path("/d", s("SUNRGBD\\a\\b.jpg"))) == "/d/SUNRGBD/a/b.jpg"
    assert one(spark, T.padded_id(F.lit(42))) == "000000000042"
    assert one(spark, T.after_marker(s("user x assistant Two 3 assistant y"))) == "two three"
    assert one(spark, T.last_sentence(s("a. B 2"))) == "b two"
    assert one(spark, T.normalized_answer(s("  It's, a\tLAMP! "))) == "its a lamp"
    assert one(spark, T.question_tokens(s("What is, the?"))) == ["what", "is", "the"]
    assert one(spark, T.val_loss(s("x/val_loss=0.25.ckpt"))) == 0.25 and one(spark, T.val_loss(s("x"))) == math.inf
    assert [one(spark, T.without_na(s(t))) for t in ("None", "n/a", "null", "NA", "nan", "none")] == [None] * 5 + ["none"]
    assert [one(spark, T.is_stop_name(s(t))) for t in ("wallet", "floral", "lamp")] == [True, True, False]


def test_arrays(spark):
    v = arr([1.0, 3.0, 3.0])
    assert one(spark, A.argmax(v)) == 1 and one(spark, A.top_k(v, 2)) == [1, 2]
    assert one(spark, A.padded(arr([1, 2], "int"), 4)) == [1, 2, 0, 0] and one(spark, A.padded(arr([1, 2, 3], "int"), 2)) == [1, 2]
    assert one(spark, A.find_subsequence(arr([5, 1, 2, 1, 2], "int"), arr([1, 2], "int"))) == 1
    assert one(spark, A.find_subsequence(arr([5], "int"), arr([1, 2], "int"))) is None
    assert one(spark, A.masked_outside(arr([5, 1, 2], "int"), arr([1, 2], "int"))) == [-100, 1, 2]
    assert one(spark, A.masked_outside(arr([5, 1], "int"), arr([9], "int"))) == [5, 1]
    assert one(spark, A.same_set(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("a"), F.lit("a"))))
    p = one(spark, A.softmax(v))
    assert abs(sum(p) - 1) < 1e-12 and abs(one(spark, A.cross_entropy(v, F.lit(0))) + math.log(p[0])) < 1e-12
    assert one(spark, A.cosine(arr([0.0, 0.0]), arr([1.0, 0.0]))) == 0.0
    assert one(spark, A.mean_pool(F.array(arr([1.0, 2.0]), arr([3.0, 6.0])))) == [2.0, 4.0]
    q = one(spark, A.calibrated(arr([0.5, 0.3, 0.2]), F.lit(1)))
    scale = 0.8 / (1 - 0.3 + 0.3)
    assert [round(x, 9) for x in q] == [0.5, round(1 - scale * 0.7, 9), 0.2]


def test_slots(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    up = slots.arrow_slot(lambda: lambda batch: batch[0].str.upper(), "string", F.col("t"))
    assert sorted(r[0] for r in df.select(up).collect()) == ["A", "B"]

    def fails(batch):
        raise RuntimeError("no network")

    assert [r["x"] for r in slots.guarded_slot(df, fails, "t", "x").collect()] == [None, None]
    assert len(one(spark, slots.stub_embedding(s("lamp")))) == 8 and one(spark, slots.stub_color(s("lamp"))) in ("black", "white", "gray", "brown", "red", "green", "blue")


def test_rows_before_the_failing_one_keep_their_answers(spark):
    def call(texts):
        if (texts == "bad").any():
            raise RuntimeError("remote")
        return texts.str.upper()

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "bad", "c"])], "i int, t string").coalesce(1)
    assert [r["x"] for r in slots.guarded_slot(df, call, "t", "x").orderBy("i").collect()] == ["A", "B", None, None]


def test_instructions(spark):
    assert one(spark, T.instruct(s("Q?"), s("yes"))) == "<s>[INST] Q?\n[IMG] [/INST] yes </s>" and one(spark, T.instruct(s("Q?"), images=0)) == "<s>[INST] Q?[/INST] "
