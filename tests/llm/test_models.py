"""Fitted operators: gradients, held-out accuracy, whole texts and edge cases."""

import random
import zlib

import numpy as np
import pytest

from normlens.llm import catalog, language_id, quality_cnn, toxicity
from normlens.llm.byte_cnn import ByteConv, held_out, windows
from normlens.llm.words import WordTable

FOLDER = "/root/testdata/sf0.01"


def test_windows_cover_every_byte():
    rng = random.Random(0)
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        text = bytes(rng.randrange(1, 256) for _ in range(n))
        rows, owner = windows([text, b"x"], 512, 448)
        assert owner.tolist() == [0] * (len(rows) - 1) + [1]
        joined = rows[0].tobytes() + b"".join(r.tobytes()[64:] for r in rows[1:-1])
        assert joined.rstrip(b"\0") == text


def test_pair_look_ups_give_the_same_features():
    conv = ByteConv((2, 3, 7), 4, 1)
    conv.bias += np.arange(12, dtype=np.float32)
    rows = np.random.default_rng(0).integers(0, 256, (70, 64), dtype=np.uint8)
    assert np.allclose(conv.pool(rows)[0], conv.compiled().pool(rows), atol=1e-5)


def test_convolution_gradient():
    conv, rng = ByteConv((2, 3), 3, 2), np.random.default_rng(1)
    rows, grad = rng.integers(0, 5, (6, 20), dtype=np.uint8), rng.normal(size=(6, 6)).astype(np.float32)
    value, at = conv.pool(rows, places=True)
    made = conv.gradient(rows, at, grad)
    for table, own in zip(conv.tables.values(), made):
        for cell in ((0, 1, 2), (1, 4, 0), (1, 2, 1)):
            old = table[cell]
            table[cell] = old + 1e-3
            up = (conv.pool(rows)[0] * grad).sum()
            table[cell] = old - 1e-3
            down = (conv.pool(rows)[0] * grad).sum()
            table[cell] = old
            assert (up - down) / 2e-3 == pytest.approx(own[cell], abs=2e-2)
    assert np.allclose(made[-1], grad.sum(axis=0))


def test_ordinal_fit_prefers_true_parameters():
    rng = np.random.default_rng(0)
    dense = rng.random((3000, 5)) < 0.4
    true = np.array([2.0, -1.0, 0.5, 0.0, 3.0])
    latent = dense @ true + rng.logistic(size=3000)
    grade = (latent > 1).astype(int) + (latent > 3.5)
    row, column = np.nonzero(dense)
    weight, theta = toxicity.fit_ordinal(row, column, 5, grade, steps=1500)
    assert np.abs(weight - true).max() < 0.35 and np.abs(theta - [1, 3.5]).max() < 0.35 and theta[0] < theta[1]


def test_features_of_whole_texts():
    row, found = toxicity.features([b"Bad bad x", b"", b"badly bad\xc3\xa9", b"BAD"])
    assert sorted(set(row.tolist())) == [0, 2, 3]
    table = WordTable([b"bad"], lower=True)
    assert [(found[row == r] == table.hash[0]).sum() for r in range(4)] == [1, 0, 0, 1]
    row, found = toxicity.features([b"bad good", b"good"] * 3, np.sort(table.hash))
    assert row.tolist() == [0, 2, 4]


def labelled(rng, n):
    clean = [" ".join(rng.choice("river stone cloud leaf grass window paper chair".split()) for _ in range(rng.randrange(5, 60))) for _ in range(n)]
    return [(i, t if i % 3 else t + " VILE " + "awful " * (i % 4), int(i % 3 == 0)) for i, t in enumerate(clean)]


def test_toxicity_frames(spark):
    rows = labelled(random.Random(2), 400)
    docs = spark.createDataFrame([(i, t, i) for i, t, _ in rows] + [(None, None, 1), (7000, "", 2), (7001, "so vile, awful", 3), (7001, "so vile, awful", 3)],
                                 "doc_id long, text string, severity int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (1, 0)], "doc_id long, toxic int")
    got = toxicity.grade(docs, labels).collect()
    assert len(got) == docs.count() and docs.columns[:2] + ["severity", "is_toxic"] == toxicity.grade(docs, labels).columns
    truth = {i: bool(y) for i, _, y in rows} | {None: False, 7000: False, 7001: True}
    assert all(r.is_toxic == truth[r.doc_id] and 0 <= r.severity <= 2 for r in got)
    assert not any(r.is_toxic for r in toxicity.grade(docs, labels.where("toxic = 0")).collect())
    assert toxicity.grade(docs.limit(0), labels).count() == 0 and not any(r.is_toxic for r in toxicity.grade(docs, labels.limit(0)).collect())


def test_held_out_fold(spark):
    got = {r.doc_id: r.h for r in spark.range(50).selectExpr("id as doc_id").select("doc_id", held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_language_query(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = catalog.QUERIES["op5_language_id"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_language_edges(spark):
    words = {"xx": "lorem ipsum dolor sit amet", "yy": "quick brown foxes jump over"}
    rows = [(i, " ".join(random.Random(i).choices(words[k].split(), k=30)), k) for i in range(300) for k in words if i % 2 == (k == "xx")]
    extra = [(9000, None, "xx"), (9001, "123 ... !", "yy"), (9002, "", None), (None, "quick brown", None), (9003, "dolor sit " * 4000, None)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    assert got[9000] == got[9001] == got[9002] == ("und", 0.0)
    assert got[None][0] == "yy" and got[9003][0] == "xx"
    assert {r.lang_pred for r in language_id.identify(docs.where("lang is null")).collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


def test_quality_query(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    got = catalog.QUERIES["op10_quality_cnn"](spark, FOLDER).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    good, bad = ([r.score for r in held if truth[r.doc_id] == y] for y in (1, 0))
    assert np.mean([[a > b for b in bad] for a in good]) > 0.85


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, "fine words here " * 20 if i % 2 else "##!! " * 30) for i in range(200)]
                                 + [(1000, None), (None, "fine words here"), (1001, "fine words " * 9000), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (5, None), (5, 1)], "doc_id long, quality int")
    got = quality_cnn.classify(docs, labels).collect()
    assert len(got) == 204 and all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 200)
    assert {r.score for r in quality_cnn.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_cnn.classify(docs.limit(0), labels).count() == 0


def test_quality_learns_from_every_chunk(spark, monkeypatch):
    texts = {i: " ".join(f"word{i}x{j}" for j in range(1500)) for i in (1, 2, 3)}
    seen = {}
    monkeypatch.setattr(quality_cnn, "fit", lambda chunks, labels: seen.update(chunks=chunks))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    quality_cnn.train(docs, spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int"))
    overlap = quality_cnn.CHUNK - quality_cnn.STRIDE
    whole = {(c[0] + b"".join(x[overlap:] for x in c[1:])).decode() for c in seen["chunks"]}
    assert whole and whole <= set(texts.values())
