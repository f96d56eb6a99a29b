"""Byte-level BPE against the tiktoken library."""

import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from normlens.llm import byte_bpe, catalog
from normlens.llm.byte_bpe import ByteBPE, RankQueue, Remembered, coder, decode, encode, read_ranks

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def library(path=PATH):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


def ids_of(bpe, text):
    return np.frombuffer(bpe.encode([text])[0], np.int32).tolist()


def test_queue_gives_ranks_in_order():
    rng, queue, seen = random.Random(0), RankQueue(), {}
    for _ in range(2000):
        rank = rng.randrange(60000)
        queue.push(rank, len(seen))
        seen.setdefault(rank, []).append(len(seen))
    out = []
    while taken := queue.pop():
        out.append(taken[0])
    assert out == sorted(seen)


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_odd_texts(name):
    path = public_tokenizers.path(name)
    bpe, own, rng = coder(path, PATTERN), library(path), random.Random(1)
    parts = ["a", " ", "  ", "\n", "\t", " \n", "'s", "'ll", "１", "²", "é", "é", "漢", " ", "\x1c", "\x85", "_", "!", "\0", "🙂",
             "the", "ing", "<|endoftext|>", " ", "﻿"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        ids = ids_of(bpe, text)
        assert ids == own.encode_ordinary(text), repr(text)
        assert bpe.decode(ids) == text.encode()


def test_very_long_pre_tokens():
    bpe, own, rng = coder(PATH, PATTERN), library(), random.Random(2)
    for text in ("a" * 30000, "".join(rng.choice("aeinrst") for _ in range(30000)), "".join(rng.choice("ab漢é") for _ in range(9000))):
        assert ids_of(bpe, text) == own.encode_ordinary(text)


def test_lower_rank_that_a_merge_makes_goes_first():
    ranks = {bytes([b]): 100 + b for b in range(256)} | {b"ab": 5, b"abc": 1, b"ca": 6, b"cab": 0}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe, rng = ByteBPE(ranks, PATTERN), random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        assert ids_of(bpe, text) == own.encode_ordinary(text), text


def test_forgetting_changes_nothing(monkeypatch):
    bpe = ByteBPE(read_ranks(PATH), PATTERN)
    bpe.chunks, bpe.words = Remembered(6), Remembered(4)
    own, rng = library(), random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta,", "gamma.\nx", "delta", "", "epsilonic"]) for _ in range(30)) for _ in range(60)]
    for lo in range(0, 60, 7):
        assert [np.frombuffer(x, np.int32).tolist() for x in bpe.encode(texts[lo:lo + 7])] == [own.encode_ordinary(t) for t in texts[lo:lo + 7]]


def test_frames(spark):
    docs = spark.createDataFrame([(1, "Hello there", "x"), (None, None, "y"), (1, "", None), (1, "Hello there", "x")],
                                 "doc_id long, text string, decoded string")
    made = encode(docs.withColumnRenamed("decoded", "ids"), PATH, PATTERN)
    assert made.columns == ["doc_id", "text", "ids"]
    rows = decode(encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted((r.text or "", bytes(r.decoded).decode()) for r in rows) == [("", ""), ("", ""), ("Hello there",) * 2, ("Hello there",) * 2]
    assert encode(docs.limit(0), PATH, PATTERN).count() == 0
    assert byte_bpe.read_ranks(PATH)[b"!"] == 0


def test_query_over_whole_table(spark):
    folder, own = "/root/testdata/sf0.001", library()
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = own.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in catalog.QUERIES["op3_byte_bpe"](spark, folder).collect()}
    assert got == want
