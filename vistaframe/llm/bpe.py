"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Method: a hierarchical-bitmap rank queue. Each merge rank has a bucket of positions in a linked list of symbols; bitmaps
over the buckets, in levels of 64, give the lowest rank by find-first-set; entries that a merge has made stale are skipped
when they come up. A pre-token of n bytes takes O(n log n) at worst, so one pre-token of megabytes is no trouble; short
ones are remembered by each worker.

At scale: one pass, no shuffle; the vocabulary (``MAX_VOCABULARY`` bytes, checked) is broadcast. Whole texts are encoded.

Defined cases
* null and empty texts: no ids, an empty list (never null). A blank text has the ids of its white space.
* a null id: kept, with the ids of its text. Repeated rows: each encoded. Columns besides the two: not read.
* special tokens: none; their strings are ordinary text. Lone surrogates, which no column of Spark can hold: replaced by ``?``.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

FOLDER = "/opt/tokenizers"
#: Proven bound of what is broadcast.
MAX_VOCABULARY = 64_000_000
#: Pre-tokens a worker remembers, and the longest of them.
MEMO, MEMO_LENGTH = 200_000, 64

#: The published pre-tokenization pattern of this tokenizer. Fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class RankQueue:
    """Positions by rank; ``pop`` gives those of the lowest rank, from left to right."""

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.levels: list[list[int]] = []
        while True:
            ranks = (ranks + 63) // 64
            self.levels.append([0] * ranks)
            if ranks == 1:
                break

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        at = rank
        for level in self.levels:
            bit = 1 << (at & 63)
            at >>= 6
            if level[at] & bit:
                return
            level[at] |= bit

    def pop(self) -> tuple[int, int] | None:
        if not self.levels[-1][0]:
            return None
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = (at << 6) | ((word & -word).bit_length() - 1)
        bucket = self.buckets[at]
        position = heapq.heappop(bucket)
        if not bucket:
            rank = at
            for level in self.levels:
                bit = 1 << (rank & 63)
                rank >>= 6
                level[rank] &= ~bit
                if level[rank]:
                    break
        return at, position


class Encoder:
    """Ids of texts under the ranks of a vocabulary file (a line for each token: base64 bytes, rank)."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        import regex

        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in vocabulary.splitlines() if line)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], int] = {}
        self.memo: dict[str, list[int]] = {}
        self.size = max(self.ranks.values()) + 1
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.queue = RankQueue(self.size)  # empty between pre-tokens

    def merged(self, left: int, right: int) -> int:
        """The rank of two neighbouring symbols, -1 if they do not merge."""
        key = (left, right)
        rank = self.pairs.get(key)
        if rank is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            rank = self.pairs[key] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return rank

    def pre_token(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        symbol = [self.single[b] for b in data]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n
        queue = self.queue
        for i in range(n - 1):
            r = pair[i] = self.merged(symbol[i], symbol[i + 1])
            if r >= 0:
                queue.push(r, i)
        while (found := queue.pop()) is not None:
            rank, i = found
            if pair[i] != rank:
                continue  # stale: a merge has changed this pair
            j = after[i]
            symbol[i] = rank
            k = after[i] = after[j]
            symbol[j] = pair[j] = -1
            if k < n:
                before[k] = i
                r = pair[i] = self.merged(rank, symbol[k])
                if r >= 0:
                    queue.push(r, i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                r = pair[h] = self.merged(symbol[h], rank)
                if r >= 0:
                    queue.push(r, h)
        return [s for s in symbol if s >= 0]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, ids = self.memo, []
        for t in self.split(text):
            found = memo.get(t)
            if found is None:
                found = self.pre_token(t.encode("utf-8", "replace"))
                if len(t) <= MEMO_LENGTH:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[t] = found
            ids += found
        return ids


_LOADED: dict[int, Encoder] = {}


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = FOLDER):
    """Broadcast of the bytes of a vocabulary file, whose size is checked."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of more than {MAX_VOCABULARY} bytes")
    return spark.sparkContext.broadcast(data)


def encoder(shared) -> Encoder:
    """The worker's encoder of a broadcast vocabulary; its memory lasts from task to task."""
    data = shared.value
    key = hash(data)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(data)
    return _LOADED[key]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(<id>, ids ARRAY<INT>) of every row."""
    shared = vocabulary(df.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = [enc.encode(t.as_py()) for t in part.column(1)]
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "ids"])

    source = df.select(f"`{id_col}`", f"`{text_col}`")
    return source.mapInArrow(run, f"`{id_col}` {source.dtypes[0][1]}, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(<id>, n_tokens BIGINT) of every row; the ids themselves do not leave the worker."""
    shared = vocabulary(df.sparkSession, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared)
        for batch in batches:
            sizes = pa.array([len(enc.encode(t.as_py())) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], names=[id_col, "n_tokens"])

    source = df.select(f"`{id_col}`", f"`{text_col}`")
    return source.mapInArrow(run, f"`{id_col}` {source.dtypes[0][1]}, n_tokens bigint")
