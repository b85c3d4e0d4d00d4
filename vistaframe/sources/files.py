"""Files: ordered lines, documents, CSV, listings, vocabularies, question pairs, checkpoints.

Formats that need a library the cluster may not have (spreadsheets, MATLAB files, pictures) come in as CSV, parquet or
bytes; ``flatten_cells`` and ``read_bytes`` take it from there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaframe.functions.text import NA_TOKENS, relative_path, strip, val_loss

#: Bytes up to which a configuration or vocabulary is read on the driver.
MAX_DRIVER_BYTES = 64_000_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(idx BIGINT, path STRING): the lines of one file in their order, stripped, blank ones kept; a line end at the end of
    the file begins no line."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\r\n?", "\n").alias("value"))
    lines = whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("idx", "path"))
    return lines.select(F.col("idx").cast("long").alias("idx"), strip(F.col("path")).alias("path"))


def zip_lines(frames: dict[str, DataFrame]) -> DataFrame:
    """(idx, one column for each list): the shortest list ends it."""
    out = None
    for name, df in frames.items():
        named = df.select("idx", F.col("path").alias(name))
        out = named if out is None else out.join(named, "idx")
    return out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc): whole text files, one row each. ``nested.parsed`` reads them without ever raising."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; the literals for missing become NULL in text columns.
    ``File_Name`` is the name of the file."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"')
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    text = {c for c, t in df.dtypes if t == "string"}
    cells = [(F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")) if c in text else F.col(f"`{c}`")).alias(c) for c in df.columns]
    return df.select(*cells, F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("File_Name"))


def read_bytes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content): files as bytes, for decoders in a slot."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content")


def list_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path) of the files with a suffix below a folder, sorted; the contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(path).select("path").orderBy("path")


def flatten_cells(df: DataFrame, name: str = "item") -> DataFrame:
    """All cells of a sheet, NULL ones left out; the header is no cell."""
    return df.select(F.explode(F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])).alias(name)).where(F.col(name).isNotNull())


VOCABULARY = ("word2idx", "idx2word", "ans2idx", "idx2ans", "config")


def read_vocabulary(spark: SparkSession, folder: str, names: Sequence[str] = VOCABULARY) -> dict[str, DataFrame]:
    """(key, value) frames of the JSON maps ``<name>.json`` of a folder, on any file system that Spark reads; a missing file is
    an error; keys that are numbers become INT. Small by contract: each map's size is checked."""
    import json

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    sizes = {n: listed.where(F.regexp_like("path", F.lit(rf"/{n}\.json(/[^/]*)?$")) & ~F.regexp_like("path", F.lit(r"/[_.][^/]*$"))).agg(F.sum("length")).first()[0] for n in names}
    if missing := [n for n, size in sizes.items() if not size]:
        raise FileNotFoundError(f"missing: {', '.join(missing)}")
    out = {}
    for n, size in sizes.items():
        if size > MAX_DRIVER_BYTES:
            raise ValueError(f"{n}.json is larger than {MAX_DRIVER_BYTES} bytes")
        pairs = list(json.loads("".join(r[0] for r in spark.read.text(f"{folder}/{n}.json", wholetext=True).collect())).items())
        if pairs and all(k.lstrip("-").isdigit() for k, _ in pairs):
            out[n] = spark.createDataFrame([(int(k), str(v)) for k, v in pairs], "key int, value string")
        else:
            out[n] = spark.createDataFrame([(k, int(v)) for k, v in pairs], "key string, value int")
    return out


def question_pairs(annotations: DataFrame, questions: DataFrame) -> DataFrame:
    """Annotations with their question text; an annotation without a question is an error, found when the rows are read.

    annotations: (annotations ARRAY<STRUCT<..., question_id>>), questions: (questions ARRAY<STRUCT<question_id, question>>)."""
    a = annotations.select(F.explode("annotations").alias("a")).select("a.*")
    q = questions.select(F.explode("questions").alias("q")).select("q.question_id", "q.question").dropDuplicates(["question_id"])
    joined = a.join(q, "question_id", "left")
    lost = F.raise_error(F.concat(F.lit("no question "), F.col("question_id").cast("string")))
    return joined.withColumn("question", F.when(F.col("question").isNull(), lost).otherwise(F.col("question")))


def first_rows(df: DataFrame, split: str, order: str, most: int) -> DataFrame:
    """At most so many rows of each split, the first by order."""
    from vistaframe.operators.ranking import capped

    return capped(df, [split], [order], most)


def best_checkpoint(df: DataFrame, path: Column) -> DataFrame:
    """(path, val_loss) of the checkpoint with the least loss in its name; names without one come last, ties by name."""
    named = df.select(path.alias("path"), val_loss(path).alias("val_loss"))
    return named.groupBy().agg(F.min_by("path", F.struct("val_loss", "path")).alias("path"), F.min("val_loss").alias("val_loss"))


def row_at(df: DataFrame, index: str, k: int) -> DataFrame:
    """The row whose index is k; an error if there is none."""
    found = df.where(F.col(index) == k)
    if found.isEmpty():
        raise IndexError(f"no row {k}")
    return found


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """CSV with a header; with order sorted over all files, which keep Spark's partitions."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_lines(df: DataFrame, path: str, column: str = "path", order: str = "idx") -> None:
    df.orderBy(order).select(column).write.mode("overwrite").text(path)


def write_vocabulary(words: DataFrame, answers: DataFrame, folder: str, config: dict[str, int]) -> None:
    """The five JSON maps that ``read_vocabulary`` reads, from frames (token, id): both directions of words and of answers, and
    the numbers of config. Each is one JSON object, written by a task; what would be too large to read again is an error."""
    spark = words.sparkSession

    def one(name: str, pairs: DataFrame) -> None:
        whole = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))))
        size = pairs.agg(F.coalesce(F.sum(F.octet_length("key") + F.octet_length(F.col("value").cast("string")) + 8), F.lit(0))).first()[0]
        if size > MAX_DRIVER_BYTES:
            raise ValueError(f"{name}.json would be larger than {MAX_DRIVER_BYTES} bytes")
        pairs.agg(whole.alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.json")

    for name, df in (("word", words), ("ans", answers)):
        one(f"{name}2idx", df.select(F.col("token").alias("key"), F.col("id").alias("value")))
        one(f"idx2{name}", inverted(df).select(F.col("id").cast("string").alias("key"), F.col("token").alias("value")))
    one("config", spark.createDataFrame(list(config.items()), "key string, value long"))


def inverted(vocabulary: DataFrame) -> DataFrame:
    """(id, token) of a vocabulary (token, id); of tokens that share an id the last in order."""
    return vocabulary.groupBy("id").agg(F.max("token").alias("token"))


def write_if_absent(df: DataFrame, folder: str, path: str = "path", content: str = "content") -> DataFrame:
    """(path, written): each content as a file below folder, where there is none yet. A file is written under another name and
    then renamed, so a task that is run again, or twice at once, leaves whole files only. folder: mounted on all executors."""
    base = folder.removeprefix("file:").replace("//", "/")

    def run(batches):
        import os
        import uuid

        for pdf in batches:
            written = []
            for name, data in zip(pdf[path], pdf[content]):
                target = f"{base}/{name}"
                fresh = data is not None and not os.path.exists(target)
                if fresh:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    part = f"{target}.{uuid.uuid4().hex}"
                    with open(part, "wb") as f:
                        f.write(data)
                    os.replace(part, target)
                written.append(fresh)
            yield pdf[[path]].assign(written=written)

    return df.select(path, content).mapInPandas(run, f"`{path}` string, written boolean")


def scene_index(meta: DataFrame, key: str, rgb_path: str, rgb_name: Column, depth_name: Column, root: str = "SUNRGBD") -> DataFrame:
    """(<key>, rgb, depth, label, annotation): where the files of each scene of the cameras' metadata lie, below root. NULL where
    the path of the picture does not hold root, or for a depth without a name. ``write_lines`` makes a list of each column."""
    folder = relative_path(F.col(rgb_path), root)
    at = lambda *parts: F.concat(F.lit(f"{root}/"), folder, *parts)
    return meta.select(
        key, at(F.lit("/image/"), rgb_name).alias("rgb"), at(F.lit("/depth_bfx/"), depth_name).alias("depth"), at(F.lit("/label/label.npy")).alias("label"), at(F.lit("/annotation/index.json")).alias("annotation")
    )


def as_base64(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn(content, F.base64(content))
