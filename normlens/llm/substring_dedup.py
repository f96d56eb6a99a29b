"""Removal of word runs that occur twice or more in a corpus, by suffix automata.

Definition. A window is ``width`` consecutive words (runs other than space and
0x09-0x0D) of one text. A word goes if a window that covers it starts at any
other place of the corpus too, in the same text or another. Windows are judged
on the input.

Method. The automata of reference shards cannot be sent to every task, as the
reference is the corpus itself and has no size bound. So texts are cut into
segments, and a shard meets only the segments that can match it:

1. Every window belongs to the smallest hash of its word grams, its anchor.
   Equal windows have equal anchors. A segment is a run of windows with one
   anchor at one place. Segments are counted by anchor with map-side sums.
2. Segments of an anchor that occurs once are unique. If all segments of an
   anchor are equal, all their windows repeat. The other anchors are dealt
   into shards, and each shard builds the suffix automaton of its distinct
   segments with occurrence counts. Its segments are streamed through it for
   matching statistics: the state that holds the last ``width`` words says how
   often they occur.
3. An anchor with more than ``hot`` segments would be one large shard, so its
   windows are counted by identity in Spark instead (exact, pre-aggregated).

Words are compared by 64-bit identity.

Edge cases: null and empty texts have no words and stay as they are; texts
shorter than the window lose nothing; rows with null or repeated ids are
separate texts, so an exact repetition of a row makes all its windows repeat;
an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normlens.llm.frames import free_names, keyed, map_batches, ready, release, texts_of
from normlens.llm.words import Spans, WordTable, blocks, sliding_min
from normlens.plans.relational import materialize

#: Words in the grams whose smallest hash anchors a window.
GRAM = 8
#: Segments of one anchor that an automaton takes; more are counted in Spark.
HOT = 200
#: Words of distinct segments in one automaton, unless one anchor has more.
SHARD_WORDS = 20_000


def segments(table: WordTable, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, windows and anchor of every segment, windows counted from the block's first word."""
    if len(table.start) < width:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    spans = Spans(table.hash)
    place = np.arange(len(table.start) - gram + 1)
    gram_hash = spans.of(place, place + gram)
    anchor = sliding_min(gram_hash, width - gram + 1)
    window = np.flatnonzero(table.room()[:len(anchor)] >= width)
    if not len(window):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    value = anchor[window]
    # The end of a text has no windows, so a gap in their numbers marks a new
    # text. A window that begins with its anchor is the last one on it, even
    # where an equal gram follows, so no window occurs twice in a segment.
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (np.diff(window) != 1)
                          | (gram_hash[window] == value)[:-1]))
    begin = np.flatnonzero(new)
    return window[begin], np.diff(np.concatenate((begin, [len(window)]))), value[begin]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def segment_rows(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(_k1, _k2, lo, n, anchor, seg): lo is the first word, n the windows, seg the identity of the words."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, parts = texts_of(batch.column("text")), []
        for lo, hi in blocks(texts):
            table = WordTable(texts[lo:hi])
            first, n, anchor = segments(table, width, gram)
            if len(first):
                row = np.searchsorted(table.first, first, side="right") - 1
                identity = Spans(table.hash).of(first, first + n + width - 1)
                parts.append((row + lo, first - table.first[row], n, _signed(anchor), _signed(identity)))
        if not parts:
            return None
        row, first, n, anchor, identity = (np.concatenate(x) for x in zip(*parts))
        take = pa.array(row)
        return pa.record_batch([batch.column("_k1").take(take), batch.column("_k2").take(take), pa.array(first, pa.int32()),
                                pa.array(n, pa.int32()), pa.array(anchor), pa.array(identity)],
                               names=["_k1", "_k2", "lo", "n", "anchor", "seg"])
    return map_batches(docs.select("_k1", "_k2", "text"), run,
                       "_k1 long, _k2 long, lo int, n int, anchor long, seg long")


class SuffixAutomaton:
    """Suffix automaton of several sequences with the number of occurrences of every state's words."""

    def __init__(self, weighted: list[tuple[list[int], int]]):
        length, link, step, count = [0], [-1], [{}], [0]
        for sequence, weight in weighted:
            last = 0
            for symbol in sequence:
                target = step[last].get(symbol)
                if target is not None and length[target] == length[last] + 1:
                    last = target
                else:
                    if target is None:
                        new = len(length)
                        length.append(length[last] + 1)
                        link.append(0)
                        step.append({})
                        count.append(0)
                        at = last
                        while at != -1 and symbol not in step[at]:
                            step[at][symbol] = new
                            at = link[at]
                        target = step[at][symbol] if at != -1 else 0
                    else:
                        new, at = -1, last
                    if at != -1 and length[target] != length[at] + 1:
                        clone = len(length)
                        length.append(length[at] + 1)
                        link.append(link[target])
                        step.append(step[target].copy())
                        count.append(0)
                        link[target] = clone
                        while at != -1 and step[at].get(symbol) == target:
                            step[at][symbol] = clone
                            at = link[at]
                        target = clone
                    if new == -1:
                        last = target
                    else:
                        link[new] = target
                        last = new
                count[last] += weight
        for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
            count[link[state]] += count[state]
        self.length, self.link, self.step, self.count = length, link, step, count

    def window_counts(self, sequence: list[int], width: int) -> list[int]:
        """Occurrences of each run of ``width`` symbols of a sequence that the automaton holds (0: not held)."""
        length, link, step, count = self.length, self.link, self.step, self.count
        state = matched = 0
        out = []
        for place, symbol in enumerate(sequence):
            while state and symbol not in step[state]:
                state = link[state]
                matched = length[state]
            target = step[state].get(symbol)
            if target is None:
                matched = 0
            else:
                state = target
                matched += 1
                while length[link[state]] >= width:
                    state = link[state]
                    matched = length[state]
            if place >= width - 1:
                out.append(count[state] if matched >= width else 0)
        return out


def repeated_in_shard(words: list[bytes], width: int) -> dict[bytes, list[tuple[int, int]]]:
    """For each distinct segment, the word spans under windows that occur twice or more among all segments."""
    number: dict[bytes, int] = {}
    for segment in words:
        number[segment] = number.get(segment, 0) + 1
    distinct = list(number)
    symbols = np.unique(np.frombuffer(b"".join(distinct), dtype=np.uint64), return_inverse=True)[1].tolist()
    sequences, at = [], 0
    for segment in distinct:
        sequences.append(symbols[at:at + len(segment) // 8])
        at += len(segment) // 8
    automaton = SuffixAutomaton([(s, number[d]) for s, d in zip(sequences, distinct)])
    out = {}
    for segment, sequence in zip(distinct, sequences):
        spans: list[tuple[int, int]] = []
        for place, times in enumerate(automaton.window_counts(sequence, width)):
            if times > 1:
                if spans and place <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], place + width)
                else:
                    spans.append((place, place + width))
        out[segment] = spans
    return out


def _automaton_spans(width: int):
    names = ["_k1", "_k2", "lo", "hi"]

    def flush(keys: list, words: list[bytes]) -> pa.RecordBatch:
        spans = repeated_in_shard(words, width)
        rows = [(k1, k2, lo + a, lo + b) for (k1, k2, lo), w in zip(keys, words) for a, b in spans[w]]
        columns = list(zip(*rows)) if rows else [[]] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                               names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words, seen, size, last = [], [], set(), 0, None
        for batch in batches:
            for anchor, k1, k2, lo, w in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if anchor != last and size >= SHARD_WORDS:
                    yield flush(keys, words)
                    keys, words, seen, size = [], [], set(), 0
                last = anchor
                keys.append((k1, k2, lo))
                words.append(w)
                if w not in seen:
                    seen.add(w)
                    size += len(w) // 8
        if words:
            yield flush(keys, words)
        release()
    return run


def _with_words(docs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(anchor, _k1, _k2, lo, words): the word identities of the given segments, read from their texts."""
    wanted = rows.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("lo", "n", "anchor")).alias("segs"))
    both = docs.select("_k1", "_k2", "text").join(wanted.hint("shuffle_hash"), ["_k1", "_k2"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, listed, out = texts_of(batch.column("text")), batch.column("segs").to_pylist(), []
        k1, k2 = batch.column("_k1").to_pylist(), batch.column("_k2").to_pylist()
        for lo, hi in blocks(texts):
            table = WordTable(texts[lo:hi])
            for row in range(lo, hi):
                base = table.first[row - lo]
                for s in listed[row]:
                    at = base + s["lo"]
                    out.append((s["anchor"], k1[row], k2[row], s["lo"], table.hash[at:at + s["n"] + width - 1].tobytes()))
        columns = list(zip(*out)) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["anchor", "_k1", "_k2", "lo", "words"])
    return map_batches(both, run, "anchor long, _k1 long, _k2 long, lo int, words binary")


def _hot_windows(rows: DataFrame, width: int) -> DataFrame:
    """(_k1, _k2, lo, hi) of repeated windows among segments with their words, by counting identities."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lo, parts = batch.column("lo").to_numpy(), []
        for i, words in enumerate(batch.column("words").to_pylist()):
            hashes = np.frombuffer(words, dtype=np.uint64)
            place = np.arange(len(hashes) - width + 1)
            parts.append((np.full(len(place), i), place + lo[i], _signed(Spans(hashes).of(place, place + width))))
        row, at, window = (np.concatenate(x) for x in zip(*parts))
        take = pa.array(row)
        return pa.record_batch([batch.column("_k1").take(take), batch.column("_k2").take(take), pa.array(at, pa.int32()),
                                pa.array(window)], names=["_k1", "_k2", "lo", "window"])
    windows = map_batches(rows, run, "_k1 long, _k2 long, lo int, window long")
    # One plan, so that the exchange of the texts is shared with the other
    # branches. The key is renamed by an expression: both sides of the join are
    # then exchanges, and Spark can split a window that very many texts have.
    again = windows.groupBy("window").count().where("count > 1").select(F.bitwise_not("window").alias("key"))
    return (windows.withColumn("key", F.bitwise_not("window")).join(again, "key")
            .select("_k1", "_k2", "lo", (F.col("lo") + width).alias("hi")))


def repeated_spans(docs: DataFrame, width: int = 35, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(_k1, _k2, spans): word spans to remove from the texts of ``keyed`` rows; texts without any are absent."""
    gram = min(gram, width)
    found = segment_rows(docs, width, gram)
    anchors = materialize(
        found.groupBy("anchor")
        .agg(F.count("*").alias("times"), F.min("seg").alias("least"), F.max("seg").alias("most"))
        .where("times > 1")
        .selectExpr("anchor", f"cast(if(least = most, 0, if(times <= {hot}, 1, 2)) as tinyint) as kind"))
    rows = materialize(found.drop("seg").join(anchors, "anchor"))
    whole = rows.where("kind = 0").select("_k1", "_k2", "lo", (F.col("lo") + F.col("n") + width - 1).alias("hi"))
    shards = _with_words(docs, rows.where("kind = 1"), width).repartition("anchor").sortWithinPartitions("anchor")
    streamed = shards.mapInArrow(_automaton_spans(width), "_k1 long, _k2 long, lo int, hi int")
    counted = _hot_windows(_with_words(docs, rows.where("kind = 2"), width), width)
    return (whole.unionByName(streamed).unionByName(counted)
            .groupBy("_k1", "_k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))


def _cut(text: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """The text without the words in the spans and the space after them; its words; removed words."""
    table = WordTable([text], hashed=False)
    n = len(table.start)
    gone = np.zeros(n + 1, dtype=np.int64)
    for s in spans:
        gone[s["lo"]] += 1
        gone[s["hi"]] -= 1
    gone = np.cumsum(gone)[:n] > 0
    until = np.concatenate((table.start[1:], [len(text)]))
    keep = np.concatenate(([0], np.flatnonzero(np.diff(gone.astype(np.int8))) + 1, [n])) if n else np.zeros(0, np.int64)
    pieces = [text[:table.start[0]]] if n else [text]
    for a, b in zip(keep[:-1], keep[1:]):
        if b > a and not gone[a]:
            pieces.append(text[table.start[a]:until[b - 1]])
    return b"".join(pieces), n, int(gone.sum())


def remove_repeated(docs: DataFrame, width: int = 35, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut, and (n_words, n_removed) of the input text.

    A text that loses nothing stays byte for byte; null stays null. ``docs``
    needs doc_id and text; columns named n_words or n_removed are replaced.
    """
    ready(docs.sparkSession)
    kept = docs.drop("n_words", "n_removed")
    k1, k2, listed_name = free_names(kept, "_k1", "_k2", "spans")
    rows = keyed(kept, names=(k1, k2))
    inner = rows.select(F.col(k1).alias("_k1"), F.col(k2).alias("_k2"), "text")
    spans = repeated_spans(inner, width, gram, hot).toDF(k1, k2, listed_name)
    schema = T.StructType([*kept.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    names = schema.names

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("text")
        listed, texts, lost, total = batch.column(listed_name).to_pylist(), texts_of(column), [], []
        nulls = column.is_null().to_pylist()
        for i, spans in enumerate(listed):
            if spans:
                texts[i], n, gone = _cut(texts[i], spans)
            else:
                n, gone = len(texts[i].split()), 0
            total.append(n)
            lost.append(gone)
        text = pa.array([None if null else t for null, t in zip(nulls, texts)], pa.binary()).cast(pa.string())
        made = {"text": text, "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(lost, pa.int64())}
        return pa.record_batch([made[c] if c in made else batch.column(c) for c in names], names=names)
    return map_batches(rows.join(spans.hint("shuffle_hash"), [k1, k2], "left"), run, schema)
