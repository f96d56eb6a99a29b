"""Quality rules as a ledger of failure bits.

``ledger`` measures every text once and evaluates every rule once; it stores
the measurements and one bit for each failed rule. Policies are versioned sets
of rules, that is masks: a text is kept if none of its bits is in the mask.
``ablations`` counts what each rule of a policy does, by bit operations on the
stored ledger alone.

A word is a run other than space and 0x09-0x0D. Measurements: n_words,
word_chars (code points in words), n_symbols (characters of ``#*$%&|<>``),
n_lines and n_dup_lines (lines, cut at newlines, that hold a word; those equal
to an earlier line), n_repeat_words (words in windows of eight words that
occur twice or more in the text, the first included).

Edge cases: null and empty texts measure zero and fail ``few_words``; repeated
rows and null ids are rows of their own; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlens.llm.frames import map_batches, ready, texts_of
from normlens.llm.words import Spans, WordTable, blocks, byte_set, mix

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rule i sets bit i; the condition says when a text fails. Bits are never given anew.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "2 * n_symbols > n_words",
    "repeated_lines": "n_lines >= 4 and 2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
#: Versions of the policy, each a set of rules.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "many_symbols", "repeated_lines", "short_words", "long_words"),
}
BASE = "v1"
CURRENT = "v2"

_SYMBOL = byte_set(SYMBOLS)
#: Bytes that begin a code point of a word: no white space, no continuation byte.
_WORD_POINT = np.ones(256, dtype=bool)
_WORD_POINT[[*b" \t\n\x0b\x0c\r", *range(0x80, 0xC0)]] = False


def mask(policy: str) -> int:
    return sum(BIT[rule] for rule in POLICIES[policy])


def _per_text(flags: np.ndarray, start: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[start[1:]] - total[start[:-1]]


def repeat_words(table: WordTable) -> np.ndarray:
    """Words of each text in windows that the text holds twice or more."""
    if len(table.start) < WINDOW:
        return np.zeros(len(table.n), dtype=np.int64)
    at = np.flatnonzero(table.room() >= WINDOW)
    # The text's number is part of the key, as windows count within a text.
    key = Spans(table.hash).of(at, at + WINDOW) ^ mix((table.text_of_word()[at] + 1).astype(np.uint64))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    cover = np.zeros(len(table.start) + 1, dtype=np.int64)
    cover[at[twice]] += 1
    np.subtract.at(cover, at[twice] + WINDOW, 1)
    return _per_text(np.cumsum(cover[:-1]) > 0, table.first)


def lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those equal to an earlier line."""
    full = [x for x in text.split(b"\n") if x.strip()]
    return len(full), len(full) - len(set(full))


def measure(texts: list[bytes]) -> list[np.ndarray]:
    """The columns of ``MEASURES``."""
    parts = []
    for lo, hi in blocks(texts):
        table = WordTable(texts[lo:hi])
        # Each text is followed by one newline, which is neither symbol nor word.
        parts.append((table.n, _per_text(_WORD_POINT[table.data], table.text_start),
                      _per_text(_SYMBOL[table.data], table.text_start),
                      *np.array([lines(t) for t in texts[lo:hi]], dtype=np.int64).T, repeat_words(table)))
    return [np.concatenate(x) for x in zip(*parts)]


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, the measurements, failed): failed has the bits of all rules that the text fails."""
    ready(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [pa.array(c.astype(np.int64)) for c in measure(texts_of(batch.column("text")))]
        return pa.record_batch([batch.column("doc_id"), *columns], names=["doc_id", *MEASURES])
    measured = map_batches(docs.select("doc_id", "text"), run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    failed = F.lit(0).cast("long")
    for name, rule in RULES.items():
        failed = failed.bitwiseOR(F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed", failed)


def fails(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def ablations(stored: DataFrame, policy: str) -> DataFrame:
    """(rule, n_failed, n_alone): texts that fail a rule of the policy, and texts that only this rule of it drops."""
    active = F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long"))
    rules = POLICIES[policy]
    counts = stored.agg(*[F.count_if(active.bitwiseAND(F.lit(BIT[r]).cast("long")) != 0).alias(f"f{i}") for i, r in enumerate(rules)],
                        *[F.count_if(active == BIT[r]).alias(f"a{i}") for i, r in enumerate(rules)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f{i}").alias("n_failed"), F.col(f"a{i}").alias("n_alone"))
                                            for i, r in enumerate(rules)])))
