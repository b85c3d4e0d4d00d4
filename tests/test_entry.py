"""What the driver sees."""

import __spark_entry__ as entry
from vistaframe.plans.predict import predicted


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    assert all(callable(f) for f in queries.values())


def test_predictions(spark):
    qa = spark.createDataFrame(
        [(1, "How many?", "Count", " TWO ", "SUNRGBD/a.jpg", None), (2, "How many?", "Count", None, None, None), (3, "x", "Count", "y", "SUNRGBD/b.jpg", "d")],
        "Question_Id long, Questions string, Question_Type string, Answers string, Image_Path string, Depth_Path string",
    )
    got = sorted((r["Question_Id"], r["Answers"], r["Model_Answer"]) for r in predicted(qa).collect())
    assert got == [(1, "two", "two"), (3, "y", "two")]
    listing = spark.createDataFrame([("SUNRGBD/b.jpg",)], "path string")
    assert [r["Question_Id"] for r in predicted(qa, listing=listing).collect()] == [3]
