"""Decoding, cuts, colours and writing of pictures."""

import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaframe.operators import imaging as I
from vistaframe.operators import ranking as R
from vistaframe.sources import files


def png(a, depth=8, filters=(0, 1, 2, 3, 4)):
    """A PNG with every kind of line, written plainly."""
    height, width, channels = a.shape
    step = channels * depth // 8
    raw = a.astype(">u2" if depth == 16 else np.uint8).tobytes()
    size, out, above = width * step, b"", bytes(width * step)
    for y in range(height):
        line, kind = raw[y * size : (y + 1) * size], filters[y % len(filters)]
        coded = bytearray()
        for i, v in enumerate(line):
            left, up, corner = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = left + up - corner
            paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            coded.append((v - (0, left, up, (left + up) // 2, paeth)[kind]) & 255)
        out, above = out + bytes([kind]) + bytes(coded), line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    color = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels,depth", [(1, 8), (1, 16), (2, 8), (3, 8), (4, 8), (3, 16)])
def test_png(channels, depth):
    a = np.random.default_rng(channels * depth).integers(0, 2**depth, (11, 7, channels))
    assert (I.png_pixels(png(a, depth)) == a).all()


def test_pictures(spark):
    a = np.zeros((6, 8, 3), int)
    a[1:5, 2:7] = (255, 0, 0)
    rows = [(1, bytearray(png(a)), [2.0, 5.0, 5.0, 2.0], [1.0, 1.0, 4.0, 4.0]), (2, bytearray(b"GIF89a"), [0.0], [0.0]), (3, None, None, None), (4, bytearray(png(a)), [0.0, 1.0, 1.0], [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "i int, content binary, x array<double>, y array<double>").withColumn("p", I.decoded(F.col("content")))
    got = {r["i"]: r for r in df.select("i", "p.height", "p.width", I.cut_out(F.col("p"), F.col("x"), F.col("y")).alias("c")).withColumn("lab", I.mean_lab(F.col("c"))).collect()}
    assert (got[1]["height"], got[1]["width"]) == (6, 8) and (got[1]["c"]["height"], got[1]["c"]["width"]) == (4, 4)
    assert np.allclose(got[1]["lab"], [53.24, 80.09, 67.2], atol=0.05)  # red
    assert got[2]["height"] is None and got[3]["c"] is None and got[4]["c"] is None and got[4]["lab"] is None


def test_files_are_written_where_there_are_none(spark, tmp_path):
    df = spark.createDataFrame([("a/l.npy", [1, 2, 3, 4], 2), ("b/l.npy", [1, 2, 3], 2)], "path string, v array<int>, w int").withColumn("content", I.npy_bytes(F.col("v"), F.col("w")))
    assert sorted(map(tuple, files.write_if_absent(df, f"file://{tmp_path}").collect())) == [("a/l.npy", True), ("b/l.npy", False)]
    assert np.load(io.BytesIO((tmp_path / "a/l.npy").read_bytes())).tolist() == [[1, 2], [3, 4]]
    assert not any(r["written"] for r in files.write_if_absent(df, f"file://{tmp_path}").collect()) and len(list((tmp_path / "a").iterdir())) == 1


def test_zip_and_trials(spark):
    a, b = spark.createDataFrame([(2, "b"), (1, "a")], "i int, x string"), spark.createDataFrame([(9, "z"), (7, "y")], "j int, w string")
    assert sorted(tuple(r) for r in R.zipped_by_position(a, b, ["i"], ["j"]).collect()) == [(1, "a", 7, "y"), (2, "b", 9, "z")]
    with pytest.raises(ValueError):
        R.zipped_by_position(a, b.limit(1), ["i"], ["j"])
    t = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 4.0), ("b", 1, 9.0), ("b", 2, 9.5), ("c", 1, 1.0), ("c", 2, None), ("d", 1, float("nan"))], "t string, s int, v double")
    assert tuple(R.best_trial(t, "t", "v").first()) == ("c", 1.0)
    assert [tuple(r) for r in R.pruned(t.where("t <> 'd'"), "t", "s", "v").orderBy("t").collect()] == [("b", 1)]
