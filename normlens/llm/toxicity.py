"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are words (runs of letters, A-Z lower-cased) and the first 4, 5 and 6
bytes of longer words, each by a 64-bit identity, present or not in a text.
Only features that labelled toxic texts have significantly more often than
other labelled texts enter the model. Of these the model learns one weight
each, shared by all thresholds: P(grade > k) = sigmoid(w.x - theta_k) with
theta_0 < theta_1. The score is the expected grade, the sum of these
probabilities, between 0 and 2.

Grades. The labels say only toxic or not, so grade 0 is a text labelled 0, and
texts labelled 1 are graded 1 or 2 by whether they hold at most or more than
the median number of those features.

The fit uses a bounded sample of labelled texts; every text is scored whole.

Edge cases: null and empty texts have no features and so the lowest score; a
null label and a null id are not learned from; of several labels of one id the
largest counts; without texts of both labels every score is 0 and nothing is
toxic; repeated rows get equal scores; an empty table gives an empty table;
other columns of the input are ignored by the model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normlens.llm.byte_cnn import Adam
from normlens.llm.frames import map_batches, ready, texts_of
from normlens.llm.words import WordTable, blocks

PREFIXES = (4, 5, 6)
#: Labelled documents that are learned from.
MAX_LABELLED = 6000
#: A feature enters the model from this many toxic texts, and this two-sample z value, on.
LEAST_TEXTS = 4
LEAST_Z = 4.5
GRADES = 3
STEPS = 400
#: Expected grade from which on a text counts as toxic.
THRESHOLD = 0.5
_SCREEN_BITS = 20

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


def features(texts: list[bytes], chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, ordered; of the chosen features (sorted identities) if given."""
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if chosen is not None:
        screen = np.zeros(1 << _SCREEN_BITS, dtype=bool)
        screen[chosen >> np.uint64(64 - _SCREEN_BITS)] = True
    for lo, hi in blocks(texts):
        table = WordTable(texts[lo:hi], lower=True, member=_LETTERS)
        row = table.text_of_word() + lo
        for size in (None, *PREFIXES):
            if size is None:
                at, identity = row, table.hash
            else:
                long = np.flatnonzero(table.end - table.start > size)
                at = row[long]
                identity = ~table.piece_hash(table.start[long], table.start[long] + size)
            if chosen is not None:
                hit = np.flatnonzero(screen[identity >> np.uint64(64 - _SCREEN_BITS)])
                at, identity = at[hit], identity[hit]
                place = np.minimum(np.searchsorted(chosen, identity), len(chosen) - 1)
                hit = chosen[place] == identity
                at, identity = at[hit], identity[hit]
            rows.append(at)
            found.append(identity)
    row, identity = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((identity, row))
    row, identity = row[order], identity[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (identity[1:] != identity[:-1])
    return row[new], identity[new]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """Weights of the chosen features (sorted identities) and the increasing thresholds."""
    chosen: np.ndarray
    weight: np.ndarray
    theta: np.ndarray

    def expected(self, texts: list[bytes]) -> np.ndarray:
        row, identity = features(texts, self.chosen)
        linear = np.bincount(row, self.weight[np.searchsorted(self.chosen, identity)], minlength=len(texts))
        return _sigmoid(linear[:, None] - self.theta).sum(axis=1)


def select(row: np.ndarray, identity: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Features that toxic texts have significantly more often, sorted."""
    values, at = np.unique(identity, return_inverse=True)
    bad = np.bincount(at, toxic[row], minlength=len(values))
    both = np.bincount(at, minlength=len(values))
    n, m = toxic.sum(), len(toxic) - toxic.sum()
    share = both / len(toxic)
    z = (bad / n - (both - bad) / m) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n + 1 / m))
    return values[(bad >= LEAST_TEXTS) & (z >= LEAST_Z) & (bad / n >= 5 * (both - bad) / m)]


def fit_ordinal(row: np.ndarray, column: np.ndarray, size: int, grade: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by the likelihood of the cumulative-link model, with a small ridge penalty."""
    n, levels = len(grade), np.arange(GRADES - 1)
    weight = np.zeros(size)
    # The first threshold, and the logarithms of the steps to the next ones.
    start = [np.log((grade <= k).mean() / max((grade > k).mean(), 1e-6)) for k in levels]
    shape = np.array([start[0], *np.log(np.maximum(np.diff(start), 0.1))])
    adam = Adam([weight, shape], 0.05)
    for _ in range(steps):
        theta = np.cumsum([shape[0], *np.exp(shape[1:])])
        linear = np.bincount(row, weight[column], minlength=n)
        # above[k] = P(grade > k); the grade's own probability is a difference of two of them.
        above = np.column_stack((np.ones(n), _sigmoid(linear[:, None] - theta), np.zeros(n)))
        here = np.maximum(above[np.arange(n), grade] - above[np.arange(n), grade + 1], 1e-9)
        slope = above * (1 - above)
        d_linear = -(slope[np.arange(n), grade] - slope[np.arange(n), grade + 1]) / here / n
        d_theta = np.array([(slope[:, k + 1] * ((grade == k + 1) / here - (grade == k) / here)).sum() / n for k in levels])
        tail = np.cumsum(d_theta[::-1])[::-1]
        adam.update([np.bincount(column, d_linear[row], minlength=size) + 1e-4 * weight / max(size, 1),
                     np.array([tail[0], *(tail[1:] * np.exp(shape[1:]))])])
    return weight, np.cumsum([shape[0], *np.exp(shape[1:])])


def fit(texts: list[bytes], toxic: np.ndarray) -> OrdinalModel | None:
    return _fit_features(*features(texts), np.asarray(toxic, dtype=np.float64))


def _fit_features(row: np.ndarray, identity: np.ndarray, toxic: np.ndarray) -> OrdinalModel | None:
    if not 0 < toxic.sum() < len(toxic):
        return None
    chosen = select(row, identity, toxic)
    if not len(chosen):
        return None
    hit = np.isin(identity, chosen)
    row, column = row[hit], np.searchsorted(chosen, identity[hit])
    held = np.bincount(row, minlength=len(toxic))
    middle = np.median(held[(toxic > 0) & (held > 0)])
    grade = np.where(toxic > 0, np.where(held > middle, 2, 1), 0)
    if not (grade == 2).any():
        grade[np.flatnonzero(grade == 1)[::2]] = 2
    weight, theta = fit_ordinal(row, column, len(chosen), grade)
    return OrdinalModel(chosen, weight, theta)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> OrdinalModel | None:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); features are made on the executors."""
    known = (labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
             .orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(max_labelled))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, identity = features(texts_of(batch.column("text")))
        ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
        listed = [identity[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        return pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array(listed, pa.binary())], names=["doc_id", "toxic", "found"])
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic")
    got = map_batches(rows, run, "doc_id long, toxic int, found binary").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by("doc_id")
    found = [np.frombuffer(x, dtype=np.uint64) for x in got.column("found").to_pylist()]
    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
    return _fit_features(row, np.concatenate(found), got.column("toxic").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: OrdinalModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs``, and severity (expected grade) and is_toxic; columns of these names are replaced."""
    ready(docs.sparkSession)
    kept = docs.drop("severity", "is_toxic")
    schema = T.StructType([*kept.schema.fields, T.StructField("severity", T.DoubleType()), T.StructField("is_toxic", T.BooleanType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        value = np.zeros(batch.num_rows) if model is None else model.expected(texts_of(batch.column("text")))
        return pa.record_batch([*batch.columns, pa.array(value), pa.array(value >= threshold)], names=schema.names)
    return map_batches(kept, run, schema)


def grade(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Fit on the labels, then ``score`` every row of ``docs``."""
    ready(docs.sparkSession)
    return score(docs, train(docs, labels, max_labelled), threshold)
