"""Ids against the two public implementations of the same vocabulary, and a round trip."""

import base64
import os
import random

import pytest

from vistaframe.llm import bpe as B

pytestmark = pytest.mark.skipif(not os.path.exists(f"{B.FOLDER}/byte_bpe_50k.tiktoken"), reason="no vocabulary files here")
POOL = ["a", "b", "é", "ß", "0", "9", " ", "\n", "\t", "  ", "'s", "'ll", "'S", "中", "😀", " ", " ", "ab", "the", "ing", ".", "!!", "<|endoftext|>", "ﬁ", "́", "₂", "Ⅷ", "\x00", "﻿", "aaaa", "=="]


@pytest.fixture(scope="module")
def mine():
    with open(f"{B.FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
        return B.Encoder(f.read())


def texts():
    rng = random.Random(8)
    out = ["", " ", "x" * 20_000, "".join(rng.choice("abcde") for _ in range(20_000)), "=" * 9_999]
    return out + ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 40))) for _ in range(3000)]


def test_same_ids_as_public_encoders(mine):
    import tiktoken
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(f"{B.FOLDER}/byte_bpe_50k.json")
    hf.encode_special_tokens = True
    tk = tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=mine.ranks, special_tokens={})
    for t in texts():
        ids = mine.encode(t)
        assert ids == hf.encode(t, add_special_tokens=False).ids == tk.encode_ordinary(t)
        assert b"".join(mine.tokens[i] for i in ids).decode() == t


def test_rank_queue():
    rng = random.Random(3)
    q, plain = B.RankQueue(50_000), []
    for _ in range(5000):
        if rng.random() < 0.6:
            e = (rng.randrange(50_000) if rng.random() < 0.7 else rng.randrange(64), rng.randrange(1000))
            q.push(*e)
            plain.append(e)
        elif plain:
            plain.sort()
            assert q.pop() == plain.pop(0)
    while plain:
        plain.sort()
        assert q.pop() == plain.pop(0)
    assert q.pop() is None


def test_frames(spark, mine):
    rows = [(1, "Hello wall"), (2, None), (3, ""), (4, "   "), (None, "x"), (1, "Hello wall")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"], list(r["ids"])) for r in B.encode(df).collect()), key=str)
    assert got == sorted(((i, mine.encode(t)) for i, t in rows), key=str)
    assert dict(got)[2] == [] and dict(got)[3] == []
    counts = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in B.token_counts(df).collect())
    assert counts == sorted((i or 0, len(mine.encode(t))) for i, t in rows)
    assert B.encode(df.limit(0)).count() == 0


def test_vocabulary_is_base64_and_rank(mine):
    assert base64.b64encode(mine.tokens[0]) and mine.size == 50_256
