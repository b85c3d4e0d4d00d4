"""New prediction files only: an anti-join for batches, a file stream with a checkpoint for the same without a list of files.

The reference has no streaming; its one incremental step (skip files that were scored before) is what this expresses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaframe.operators.curation import without_files
from vistaframe.operators.metrics import matches, scored_files


def merge_results(done: DataFrame, fresh: DataFrame) -> DataFrame:
    """Results scored before and those of files that are new; without new files the old ones as they are."""
    return done.unionByName(without_files(fresh, done), allowMissingColumns=True)


def score_new_files(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str) -> int:
    """Scores the parquet files of a folder that no earlier call has seen and appends the results to out; the number of
    micro-batches. A file is never scored twice, whatever executor is lost in between: the stream's checkpoint knows."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(folder)
    named = stream.withColumn("File_Name", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))

    written: set[int] = set()

    def write(batch: DataFrame, batch_id: int) -> None:
        written.add(batch_id)
        match = matches(F.col("Model_Answer"), F.col("Answers"))
        scored_files(batch, "File_Name", "Question_Type", match, match.cast("double")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(written)


def windowed_counts(stream: DataFrame, at: str, kind: str, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows by time window and kind, late rows within the watermark included; for batches and for streams. An extension."""
    return stream.withWatermark(at, late).groupBy(F.window(at, length), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")
