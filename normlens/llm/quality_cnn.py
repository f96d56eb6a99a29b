"""Quality scores by a byte-level convolutional network over whole documents.

Overlapping chunks cover every byte of a text. Learned filters run over each
chunk and are max-pooled; the mean and the maximum of the chunks' features
enter one logistic unit, which gives one probability for the document. The
network is fitted in numpy on a bounded sample of labelled documents.

Edge cases: null and empty texts have one empty chunk and get the score of
that; rows without a label or in the held-out fold are never learned from;
without labelled rows every score is 0.5; a document with several labels
takes their smallest; repeated rows get equal scores; other columns of the
input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.llm.byte_cnn import Adam, ByteConv, PairConv, held_out, labelled_ids, windows
from normlens.llm.frames import map_batches, ready, texts_of

CHUNK = 512
STRIDE = 448
WIDTHS = (4, 7)
FILTERS = 10
#: Labelled documents that are learned from, each with all its chunks.
MAX_LABELLED = 3000
#: Chunks that are convolved at once while fitting.
FIT_CHUNKS = 256
EPOCHS = 8
#: From this score on a document is predicted to have label 1.
THRESHOLD = 0.3


@dataclass
class QualityModel:
    conv: PairConv
    weight: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        rows, owner = windows(texts, CHUNK, STRIDE)
        hidden = np.maximum(self.conv.pool(rows), 0)
        first = np.searchsorted(owner, np.arange(len(texts)))
        mean = np.add.reduceat(hidden, first, axis=0) / np.bincount(owner)[:, None]
        logit = np.concatenate((mean, np.maximum.reduceat(hidden, first, axis=0)), axis=1) @ self.weight + self.bias
        return 1 / (1 + np.exp(-logit.astype(np.float64)))


def fit(texts: list[list[bytes]], labels: list[int], epochs: int = EPOCHS, seed: int = 5) -> QualityModel:
    """Each document is given as its chunks."""
    conv, rng = ByteConv(WIDTHS, FILTERS, seed), np.random.default_rng(seed)
    target = np.array(labels, dtype=np.float32)
    weight = rng.normal(0, 0.1, 2 * conv.size).astype(np.float32)
    share = float(np.clip(target.mean(), 0.01, 0.99))
    bias = np.array([np.log(share / (1 - share))], dtype=np.float32)
    adam = Adam([*conv.parameters(), weight, bias], 0.01)
    for epoch in range(epochs):
        adam.rate = 0.01 if epoch < epochs // 2 else 0.003
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), 32):
            part = order[lo:lo + 32]
            chunks = [texts[i] for i in part]
            rows = np.zeros((sum(map(len, chunks)), CHUNK), dtype=np.uint8)
            for row, chunk in zip(rows, (c for doc in chunks for c in doc)):
                row[:len(chunk)] = np.frombuffer(chunk, dtype=np.uint8)
            count = np.array([len(c) for c in chunks])
            owner, first = np.repeat(np.arange(len(part)), count), np.cumsum(count) - count
            pooled = [conv.pool(rows[i:i + FIT_CHUNKS], places=True) for i in range(0, len(rows), FIT_CHUNKS)]
            value = np.concatenate([v for v, _ in pooled])
            at = {width: np.concatenate([p[width] for _, p in pooled]) for width in WIDTHS}
            hidden = np.maximum(value, 0)
            mean = np.add.reduceat(hidden, first, axis=0) / count[:, None]
            top = np.maximum.reduceat(hidden, first, axis=0)
            seen = np.concatenate((mean, top), axis=1)
            error = (1 / (1 + np.exp(-(seen @ weight + bias))) - target[part]) / len(part)
            back = error[owner, None] * (weight[:conv.size] / count[owner, None] + weight[conv.size:] * (hidden == top[owner]))
            back *= value > 0
            adam.update([*conv.gradient(rows, at, back), seen.T @ error + 1e-4 * weight, error.sum(keepdims=True)])
    return QualityModel(conv.compiled(), weight, float(bias[0]))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> QualityModel | None:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality) outside the held-out fold."""
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    known = labelled_ids(known, max_labelled)

    def sample(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column("text"))
        rows, owner = windows(texts, CHUNK, STRIDE)
        chunks: list[list[bytes]] = [[] for _ in texts]
        for row, i in zip(rows, owner.tolist()):
            chunks[i].append(row.tobytes().rstrip(b"\0"))
        return pa.record_batch([batch.column("doc_id"), pa.array(chunks, pa.list_(pa.binary())), batch.column("quality")],
                               names=["doc_id", "chunks", "quality"])
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])
    got = map_batches(rows.select("doc_id", "text", "quality"), sample, "doc_id long, chunks array<binary>, quality int").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by("doc_id")
    return fit(got.column("chunks").to_pylist(), got.column("quality").to_pylist())


def score(docs: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    ready(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column("text"))
        value = np.full(len(texts), 0.5) if model is None else model.scores(texts)
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(value),
                                pa.array((value >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
    return map_batches(docs.select("doc_id", held_out().alias("held_out"), "text"), run,
                       "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Fit on the labels and score every row of ``docs``."""
    ready(docs.sparkSession)
    return score(docs, train(docs, labels, max_labelled))
