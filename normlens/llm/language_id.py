"""Language identification by a byte convolutional network.

Filters of several widths run over windows of fixed length, max pooling keeps
each filter's best value, and a softmax layer gives one probability for each
language. A document's probabilities are the mean over the windows that cover
its whole text, weighted by their bytes. The network is fitted in numpy on a
bounded sample of labelled texts.

Edge cases: a null text, or one without a letter, is ``und`` with score 0;
rows without a label or in the held-out fold are never learned from; without
any labelled row every text is ``und``; repeated rows get equal results; of
equal probabilities the first language in order wins; very long texts are
learned from and scored by all of their windows; an empty table gives an empty
table; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normlens.llm.byte_cnn import Adam, ByteConv, PairConv, held_out, labelled_ids, windows
from normlens.llm.frames import map_batches, ready, texts_of

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Labelled documents that are learned from, with all windows of their texts.
MAX_LABELLED = 3000
EPOCHS = 4
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    conv: PairConv
    weight: np.ndarray
    bias: np.ndarray

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """One row of language probabilities for each text."""
        rows, owner = windows(texts, WINDOW, WINDOW)
        logits = np.maximum(self.conv.pool(rows), 0) @ self.weight + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        soft = np.exp(logits)
        soft /= soft.sum(axis=1, keepdims=True)
        size = np.maximum((rows != 0).sum(axis=1), 1)
        total = np.zeros((len(texts), len(self.languages)))
        np.add.at(total, owner, soft * size[:, None])
        return total / total.sum(axis=1, keepdims=True)


def fit(texts: list[bytes], labels: list[str], epochs: int = EPOCHS, seed: int = 11) -> LanguageModel:
    languages = sorted(set(labels))
    rows, owner = windows(texts, WINDOW, WINDOW)
    index = {language: i for i, language in enumerate(languages)}
    target = np.array([index[x] for x in labels], dtype=np.int64)[owner]
    conv, rng = ByteConv(WIDTHS, FILTERS, seed), np.random.default_rng(seed)
    weight = rng.normal(0, 0.1, (conv.size, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    # Every language counts alike, however many texts it has.
    share = (len(rows) / len(languages) / np.bincount(target, minlength=len(languages))).astype(np.float32)
    adam = Adam([*conv.parameters(), weight, bias], 0.01)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 64):
            part = order[lo:lo + 64]
            x, y = rows[part], target[part]
            value, at = conv.pool(x, places=True)
            hidden = np.maximum(value, 0)
            logits = hidden @ weight + bias
            soft = np.exp(logits - logits.max(axis=1, keepdims=True))
            soft /= soft.sum(axis=1, keepdims=True)
            soft[np.arange(len(y)), y] -= 1
            soft *= share[y][:, None] / len(y)
            back = (soft @ weight.T) * (value > 0)
            adam.update([*conv.gradient(x, at, back), hidden.T @ soft, soft.sum(axis=0)])
    return LanguageModel(languages, conv.compiled(), weight, bias)


def train(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> LanguageModel | None:
    """A model from the labelled rows of ``docs`` (doc_id, text, lang) outside the held-out fold.

    Of the rows of one id, that with the smallest text hash (then language) is
    learned from, so the bound holds for repeated ids too.
    """
    known = docs.where("lang is not null and text is not null")
    ids = labelled_ids(known.select("doc_id"), max_labelled).distinct()
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "lang")
    rows = (known.join(F.broadcast(ids), "doc_id").where(~held_out())
            .withColumn("place", F.row_number().over(first)).where("place = 1").select("doc_id", "text", "lang"))

    def sample(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, owner = windows(texts_of(batch.column("text")), WINDOW, WINDOW)
        take = pa.array(owner)
        return pa.record_batch([pa.array([r.tobytes() for r in found], pa.binary()), batch.column("lang").take(take)],
                               names=["bytes", "lang"])
    got = map_batches(rows, sample, "bytes binary, lang string").toArrow()
    if not got.num_rows:
        return None
    pairs = sorted(zip((b.rstrip(b"\0") for b in got.column("bytes").to_pylist()), got.column("lang").to_pylist()))
    return fit([b for b, _ in pairs], [x for _, x in pairs])


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; score is the probability of lang_pred."""
    ready(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("text")
        texts = texts_of(column)
        letter = regex.compile(r"\p{L}").search
        known = np.array([model is not None and letter(t.decode()) is not None for t in texts])
        names, score = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
        where = np.flatnonzero(known)
        if len(where):
            chance = model.probabilities([texts[i] for i in where])
            best = chance.argmax(axis=1)
            names[where] = np.array(model.languages, dtype=object)[best]
            score[where] = np.minimum(chance.max(axis=1), 1.0)
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(names.tolist(), pa.string()), pa.array(score)],
                               names=["doc_id", "held_out", "lang_pred", "score"])
    return map_batches(docs.select("doc_id", held_out().alias("held_out"), "text"), run,
                       "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Fit on the labelled rows of ``docs`` and predict every row."""
    ready(docs.sparkSession)
    return predict(docs, train(docs.select("doc_id", "text", "lang"), max_labelled))
