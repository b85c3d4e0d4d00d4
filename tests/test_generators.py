"""From annotations to curated questions on a small fixture."""

import json

import pytest

from vistaframe.plans import questions as Q


@pytest.fixture
def folder(spark, tmp_path):
    def poly(i, x, y, z):
        return {"object": i, "x": [x, x + 10 + i, x + 10 + i, x, x], "y": [y, y, y + 10, y + 10, y], "XYZ": [[0, 0, z]]}

    docs = {
        1: {"objects": [{"name": "desklamp"}, {"name": "chair2"}, {"name": "chair 3"}], "frames": [{"polygon": [poly(0, 0, 0, 1), poly(1, 100, 0, 5), poly(2, 0, 300, 6)]}]},
        2: {"objects": [{"name": "box."}, {"name": "Table"}], "frames": [{"polygon": [poly(0, 0, 0, 1), poly(1, 50, 50, 5)]}]},
        3: {"objects": [], "frames": []},
        5: {"objects": [{}, {"name": "sofa"}], "frames": [{"polygon": [poly(0, 0, 0, 1), poly(1, 50, 50, 5)]}]},
    }
    rows = [(i, 10 + i, json.dumps(d)) for i, d in docs.items()] + [(4, 14, "{bad"), (1, 11, json.dumps(docs[1]))]
    write = lambda name, data, schema: spark.createDataFrame(data, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    write("annotation", rows, "annotation_id long, scene_idx long, doc string")
    write("scene", [(i, f"SUNRGBD/s/p/r_{i}/image/{i}.jpg", f"SUNRGBD/s/p/r_{i}/depth/{i}.png") for i in (11, 11, 12, 13)], "scene_idx long, rgb_path string, depth_path string")
    write("combined_word_map", [("desklamp", "desk lamp")], "combined_word string, separated_word string")
    write("canonical_item", [(1, "box", "object"), (2, "Chair", "object"), (3, "red", "color")], "item_id long, item string, kind string")
    return str(tmp_path)


def rows(df):
    return sorted((r["annotation_id"], r["Questions"], r["Answers"]) for r in df.collect())


def test_generators(spark, folder):
    assert rows(Q.count_every(spark, folder)) == [(1, "How many chair threes are there?", "one"), (1, "How many chairs are there?", "one"), (1, "How many desk lamps are there?", "one"), (2, "How many boxs are there?", "one"), (2, "How many tables are there?", "one"), (5, "How many sofas are there?", "one")]
    every = rows(Q.yes_no_every(spark, folder))
    assert (2, "Is there any box.?", "yes") in every and (2, "Is there any box?", "no") in every and (1, "Is there any chair?", "no") in every and not [r for r in every if r[0] in (3, 4)]
    assert not [r for kind in (False, True) for r in rows(Q.proximity(spark, folder, farthest=kind)) if "null" in r[1]]  # scene 5's prominent object may have no name
    half = Q.halved(Q.yes_no(spark, folder)).collect()
    assert len(half) == len(Q.yes_no(spark, folder).collect()) // 2


def test_completed_rows_are_what_curation_requires(spark, folder):
    got = {r["annotation_id"]: r for r in Q.completed(spark, folder, Q.object_identification(spark, folder)).collect()}
    assert {i: (r["IDs"], r["Image_Path"]) for i, r in got.items()} == {1: (1, "SUNRGBD/s/p/r_11/image/11.jpg"), 2: (2, "SUNRGBD/s/p/r_12/image/12.jpg"), 5: (3, None)}
    assert Q.chain(spark, folder).count() == 0  # fewer pictures than types
    chain = Q.chain(spark, folder, balance=False).collect()
    assert chain and sorted(r["Question_Id"] for r in chain) == list(range(1, len(chain) + 1)) and {"IDs", "Image_Path", "Depth_Path"} <= set(chain[0].asDict())
