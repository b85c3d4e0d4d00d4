"""Frequency of every distinct value and word of a collection, by recursive radix spilling.

Method: terms are counted within their record and pre-aggregated in each map task, where the record was read, then
partitioned by the leading bits of their hash; each partition is aggregated out of core with DuckDB, and one that is larger
than ``SPILL_ROWS`` or ``SPILL_BYTES`` is first split to disk by the next bits, again and again until its parts fit.

At scale: no term is shuffled before it is counted, and a map task sends each of its terms once for every ``COMBINE_ROWS``
occurrences, so a term that fills a third of the collection arrives as a few rows a task. Memory is bounded by the two
limits, DuckDB's own and the largest record, whatever the number of distinct terms and their length. Nothing is collected.

Defined cases
* null values and values of only white space: no value; a record without any value does not count as a record.
* a null record id: not a record. A record sent again counts once.
* ties need no rule: every term comes out. Very long values: counted whole.
* empty tables: no rows. Columns besides those named: not read.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaframe.operators.nested import object_name, parsed
from vistaframe.session import cut, shared_folder

#: Rows and bytes a task holds before it splits its partition to disk.
SPILL_ROWS, SPILL_BYTES = 1_000_000, 128 << 20
#: Occurrences pre-aggregated at a time in a map task; a record's stay together.
COMBINE_ROWS = 200_000
#: Bits taken at each level of splitting.
BITS = 4
#: Memory DuckDB may take in a task; beyond that it goes to disk.
DUCKDB_MEMORY = "256MB"

SCHEMA = "hash LONG, field STRING, unit STRING, term STRING, occurrences LONG, records LONG"
_ARROW = pa.schema([("hash", pa.int64()), ("field", pa.string()), ("unit", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])
_COUNT = """SELECT hash, field, unit, term, sum(n)::BIGINT AS occurrences, count(*)::BIGINT AS records
FROM (SELECT ordinal, hash, field, unit, term, count(*) AS n FROM {} GROUP BY ALL) GROUP BY ALL"""
_SUM = "SELECT hash, field, unit, term, sum(occurrences)::BIGINT AS occurrences, sum(records)::BIGINT AS records FROM {} GROUP BY ALL"


def _duckdb(folder: str):
    import duckdb

    db = duckdb.connect(":memory:")
    db.execute("SET threads = 1")
    db.execute(f"SET memory_limit = '{DUCKDB_MEMORY}'")
    db.execute("SET preserve_insertion_order = false")
    db.execute(f"SET temp_directory = '{folder}'")
    return db


def _rows(db, query: str) -> Iterator[pa.RecordBatch]:
    found = db.sql(query)
    for batch in found.to_arrow_reader(50_000) if hasattr(found, "to_arrow_reader") else found.fetch_arrow_reader(50_000):
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, _ARROW)], schema=_ARROW)


class RadixSpill:
    """Aggregates a stream of batches of ``_ARROW``; the hash bits from ``level`` on are still free to split by."""

    def __init__(self, folder: str, rows: int = SPILL_ROWS, bits: int = BITS, size: int = SPILL_BYTES) -> None:
        self.folder, self.rows, self.bits, self.size = folder, rows, bits, size
        self.splits = 0

    def aggregate(self, batches: Iterable[pa.RecordBatch], level: int = 0) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, size, stream = 0, 0, iter(batches)
        for batch in stream:
            held.append(batch)
            count += batch.num_rows
            size += batch.nbytes
            if (count > self.rows or size > self.size) and level + self.bits <= 64:
                yield from self._split(held, stream, level)
                return
        if held:
            yield from self._out_of_core(held)

    def _out_of_core(self, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _duckdb(self.folder)
        try:
            part = pa.Table.from_batches(held, schema=_ARROW)
            db.register("part", part)
            yield from _rows(db, _SUM.format("part"))
        finally:
            db.close()

    def _split(self, held: list[pa.RecordBatch], stream: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
        import numpy as np

        self.splits += 1
        os.makedirs(self.folder, exist_ok=True)
        paths, writers, sizes = {}, {}, {}
        mask = (1 << self.bits) - 1

        def both() -> Iterator[pa.RecordBatch]:
            while held:
                yield held.pop(0)
            yield from stream

        for batch in both():
            digit = (batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - level - self.bits)) & np.uint64(mask)
            for d in np.unique(digit):
                part = batch.filter(pa.array(digit == d))
                if d not in writers:
                    paths[d] = f"{self.folder}/{uuid.uuid4().hex}.arrow"
                    writers[d] = pa.ipc.new_stream(paths[d], _ARROW)
                writers[d].write_batch(part)
                sizes[d] = sizes.get(d, 0) + part.num_rows
        for w in writers.values():
            w.close()
        for d in sorted(paths):
            with pa.memory_map(paths[d]) as source, pa.ipc.open_stream(source) as reader:
                yield from self.aggregate(reader, level + self.bits)
            os.remove(paths[d])


def _scratch(shared: str) -> str:
    """A folder for what one task spills: in the shared folder if that is mounted, else where the executor runs."""
    base = shared.removeprefix("file:").replace("//", "/") if shared.startswith(("file:", "/")) else os.getcwd()
    return f"{base}/spill-{uuid.uuid4().hex}"


def _combine(shared: str):
    """Counts of the terms of whole records: rows (ordinal, hash, field, unit, term) come record by record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            folder = _scratch(shared)
            db = _duckdb(folder)
            try:
                db.register("part", pa.Table.from_batches(parts))
                yield from _rows(db, _COUNT.format("part"))
            finally:
                db.close()
                shutil.rmtree(folder, ignore_errors=True)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= COMBINE_ROWS:
                ordinals = batch.column(0).to_numpy()
                open_ = int((ordinals != ordinals[-1]).sum())  # the last record may go on in the next batch
                if open_:
                    yield from flush([*held[:-1], batch.slice(0, open_)])
                    held = [batch.slice(open_)]
                    count = held[0].num_rows
        if held:
            yield from flush(held)

    return run


def _reduce(shared: str, rows: int, bits: int, used: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = _scratch(shared)
        try:
            # the leading bits chose the task, so splitting starts after them
            yield from RadixSpill(folder, rows, bits).aggregate(batches, used)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def names_of(annotation: DataFrame, field: str = "annotation.name", id_col: str = "annotation_id", doc_col: str = "doc") -> DataFrame:
    """(field, record_id, values): the string names of the elements of ``objects``, a row for each record. Only the names
    are shuffled to drop repeats, not the documents."""
    annotation.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    objects = F.try_variant_get(parsed(F.col(f"`{doc_col}`")), "$.objects", "array<variant>")
    rows = annotation.select(F.col(f"`{id_col}`").alias("record_id"), F.filter(F.transform(objects, object_name), lambda n: n.isNotNull()).alias("values"))
    return rows.distinct().select(F.lit(field).alias("field"), "record_id", "values")


def values_of(df: DataFrame, field: str, id_col: str, value_col: str, missing: Iterable[str] = ()) -> DataFrame:
    """(field, record_id, values) with one value a record; literals in missing are no values."""
    value = F.col(f"`{value_col}`")
    rows = df.select(F.col(f"`{id_col}`").alias("record_id"), value.alias("value")).where(value.isNotNull() & ~value.isin(list(missing)))
    return rows.distinct().select(F.lit(field).alias("field"), "record_id", F.array("value").alias("values"))


def term_counts(records: list[DataFrame], rows: int = SPILL_ROWS, bits: int = BITS) -> DataFrame:
    """(field, unit, term, occurrences, records) of every value and word, and a row with unit ``all`` and an empty term for
    each field, which counts its records. records: frames (field, record_id, values), one row for each record."""
    spark = records[0].sparkSession
    shared = shared_folder(spark)
    all_rows = reduce(DataFrame.unionAll, records).where(F.col("record_id").isNotNull())
    values = F.filter(F.transform("values", lambda v: strip(F.lower(v))), lambda v: v.isNotNull() & (v != ""))
    row = lambda unit, term: F.struct(F.lit(unit).alias("unit"), term.alias("term"))
    # a filter on the values would parse the documents twice; a record without any has no terms instead
    terms = F.when(F.size("values") > 0, F.concat(
        F.array(row("all", F.lit(""))),
        F.transform("values", lambda v: row("value", v)),
        F.flatten(F.transform("values", lambda v: F.transform(F.regexp_extract_all(v, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: row("word", w)))),
    ))
    clean = all_rows.select("field", "record_id", values.alias("values"))
    # a record is one row; its ordinal only tells it from the others of its task, so that its terms are counted where it is
    said = clean.withColumn("ordinal", F.monotonically_increasing_id()).select("field", "ordinal", F.inline_outer(terms)).where(F.col("unit").isNotNull())
    combined = said.select("ordinal", F.xxhash64("field", "unit", "term").alias("hash"), "field", "unit", "term").mapInArrow(_combine(shared), SCHEMA)
    used = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    radix = F.shiftrightunsigned("hash", 64 - used)
    parts = combined.repartitionById(1 << used, radix.cast("int"))  # the digit is the partition: every task gets its own
    return parts.mapInArrow(_reduce(shared, rows, bits, used), SCHEMA).drop("hash")


def marked_terms(counts: DataFrame, rare_below: int = 3, common_permille: int = 50) -> DataFrame:
    """counts with a mark: ``rare`` in fewer than so many records, ``common`` in more than this share of the records that
    hold a value, else NULL. There is one total for each field, so the totals are broadcast."""
    counts = cut(counts, "terms")
    totals = counts.where(F.col("unit") == "all").select(F.col("field").alias("of_field"), F.col("records").alias("total"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * 1000 > F.col("total") * common_permille, "common")
    joined = counts.where(F.col("unit") != "all").join(F.broadcast(totals), F.col("field") == F.col("of_field"))
    return joined.select("field", "unit", "term", "occurrences", "records", mark.alias("mark"))
