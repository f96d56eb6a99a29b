"""Byte-level BPE with a hierarchical-bitmap rank queue: encoding and decoding of whole texts.

A text is cut by a pattern into pre-tokens. A pre-token that is a token is one
id; any other is merged pair by pair, the lowest rank first and the leftmost
of equal ranks, until no neighbouring pair is a token. A rank is also the id
of the merged token.

The queue of possible merges is a bucket of positions for each rank, with two
levels of bitmaps above: a leaf word has a bit for each rank that has a
bucket, the summary a bit for each leaf that is not empty. Find-first-set on
the summary and on the leaf gives the next rank. Positions are starts of
symbols in a doubly linked list; a merge leaves the positions of vanished
pairs in their buckets, and they are recognised as stale when taken. A merge
is a few steps, however long the pre-token is. New pre-tokens of a batch share
one queue: they are laid end to end with a byte between them that no token
holds, so the cost of a rank is shared by all places that have it.

Chunks of text (a run of white space and the run of other characters after
it) repeat. The pattern never joins a character with white space that follows
it, so a chunk is cut alike wherever it stands, and each worker keeps a
bounded table of chunks that it has encoded. Results do not depend on it.

Edge cases: null and empty texts have no ids and decode to nothing; lone
bytes of any value are tokens, so every text can be encoded and every list of
known ids decoded; an unknown id raises. Special tokens are ordinary text.
Repeated rows are encoded alike; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from normlens.llm.frames import map_batches, ready, texts_of
from normlens.llm.words import blocks

LEAF_BITS = 8
#: Two ids of this many bits name a pair.
ID_BITS = 20
#: Chunks, and pre-tokens, that a worker remembers; the oldest half is forgotten.
REMEMBERED = 60_000
#: Bytes of pre-tokens that share a queue, or one longer pre-token.
QUEUE_BYTES = 1 << 17
#: Bytes of texts that are encoded together, or one longer text.
AT_ONCE = 1 << 20
#: Longer chunks are rare and are not remembered.
REMEMBERED_CHARS = 64
#: Marks the first part of a text, which no space stands before; no text holds a lone surrogate.
FIRST = "\ud800"
#: Bytes that UTF-8 does not use.
UNUSED_BYTES = (0xC0, 0xC1, *range(0xF5, 0x100))


class Remembered:
    """A table that forgets what was not asked for lately."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size // 2, {}, {}

    def get(self, key: str) -> bytes | None:
        """Also for keys that are not in ``new``."""
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


class RankQueue:
    """Positions in buckets by rank, taken from the lowest rank that has any."""

    def __init__(self) -> None:
        self.summary = 0
        self.leaves: dict[int, int] = {}
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.fill(rank, [position])

    def fill(self, rank: int, positions: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = positions
        leaf = rank >> LEAF_BITS
        self.leaves[leaf] = self.leaves.get(leaf, 0) | 1 << (rank & (1 << LEAF_BITS) - 1)
        self.summary |= 1 << leaf

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its bucket, which leaves the queue."""
        if not self.summary:
            return None
        leaf = (self.summary & -self.summary).bit_length() - 1
        bits = self.leaves[leaf]
        bit = bits & -bits
        bits ^= bit
        self.leaves[leaf] = bits
        if not bits:
            self.summary ^= 1 << leaf
        rank = leaf << LEAF_BITS | bit.bit_length() - 1
        return rank, self.buckets.pop(rank)


class ByteBPE:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        size = max(ranks.values(), default=-1) + 1
        self.tokens: list[bytes | None] = [None] * size
        #: Rank of the token that two neighbouring tokens make, by both ids.
        self.pairs: dict[int, int] = {}
        self.pair_rank = np.full(1 << 16, -1, dtype=np.int32)
        self.byte_rank = np.full(256, -1, dtype=np.int32)
        used = set()
        for token, rank in ranks.items():
            self.tokens[rank] = token
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << ID_BITS | right] = rank
            if len(token) > 1:
                used.update(token)
            else:
                self.byte_rank[token[0]] = rank
            if len(token) == 2:
                self.pair_rank[token[0] << 8 | token[1]] = rank
        self.barrier = bytes([next(b for b in UNUSED_BYTES if b not in used)])
        self.spelled: list[bytes] = []
        self.chunks, self.words = Remembered(remembered), Remembered(remembered)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as 32-bit integers in bytes; all of them share one queue."""
        whole = self.barrier + self.barrier.join(pieces) + self.barrier
        n = len(whole)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = RankQueue()
        data = np.frombuffer(whole, dtype=np.uint8).astype(np.int32)
        # A barrier has no id; with -1 on either side no pair is found.
        token = np.where(data == self.barrier[0], -1, self.byte_rank[data]).tolist()
        first = self.pair_rank[data[:-1] << 8 | data[1:]]
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0):]
        values, at = np.unique(first[order], return_index=True)
        for rank, places in zip(values.tolist(), np.split(order, at[1:])):
            queue.fill(rank, places.tolist())
        pair = first.tolist()
        pair.append(-1)
        buckets, lookup = queue.buckets, self.pairs.get
        taken = queue.pop()
        while taken:
            rank, bucket = taken
            if len(bucket) > 1:  # merges of other ranks may have added places, so order them again
                bucket.sort()
            for index, at in enumerate(bucket):
                if pair[at] != rank:
                    continue  # stale: the symbol here is gone, or it or the next one has grown
                middle, left = after[at], before[at]
                end = after[middle]
                after[at], before[end] = end, at
                token[at], token[middle], pair[middle] = rank, -1, -1
                lowest = rank
                new = lookup(rank << ID_BITS | token[end])
                if new is None:
                    pair[at] = -1
                else:
                    pair[at] = new
                    if new in buckets:
                        buckets[new].append(at)
                    else:
                        queue.push(new, at)
                    lowest = min(lowest, new)
                new = lookup(token[left] << ID_BITS | rank)
                if new is None:
                    pair[left] = -1
                else:
                    pair[left] = new
                    if new in buckets:
                        buckets[new].append(left)
                    else:
                        queue.push(new, left)
                    lowest = min(lowest, new)
                if lowest < rank:
                    for place in bucket[index + 1:]:
                        queue.push(rank, place)
                    break
            taken = queue.pop()
        # Barriers and vanished symbols have no id.
        left = np.array(token, dtype=np.int32)
        alive = left >= 0
        begin = np.cumsum([1, *(len(p) + 1 for p in pieces)])
        upto = (4 * np.concatenate(([0], np.cumsum(alive)))[begin]).tolist()
        ids = left[alive].tobytes()
        return [ids[a:b] for a, b in zip(upto, upto[1:])]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids, as 32-bit integers in bytes, of chunks."""
        cut = {chunk: self.pieces(chunk) for chunk in chunks}
        known: dict[str, bytes] = {}
        missing: dict[str, None] = {}
        for pieces in cut.values():
            for piece in pieces:
                if piece not in known:
                    ids = self.words.new.get(piece) or self.words.get(piece)
                    if ids is None:
                        missing[piece] = None
                    else:
                        known[piece] = ids
        rest = []
        for piece in missing:
            rank = self.ranks.get(piece.encode())
            if rank is None:
                rest.append(piece)
            else:
                known[piece] = np.int32(rank).tobytes()
        coded = [p.encode() for p in rest]
        for lo, hi in blocks(coded, QUEUE_BYTES):
            for piece, ids in zip(rest[lo:hi], self.merge(coded[lo:hi])):
                known[piece] = ids
                if len(piece) <= REMEMBERED_CHARS:
                    self.words.put(piece, ids)
        return {chunk: b"".join([known[p] for p in pieces]) for chunk, pieces in cut.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers in bytes."""
        chunks = self.chunks
        found: list[tuple[list[str], list[bytes | None], list[int]]] = []
        missing: dict[str, bytes] = {}
        for text in texts:
            # Each part but the first stands for a space and itself.
            parts = text.split(" ")
            parts[0] = FIRST + parts[0]
            ids = list(map(chunks.new.get, parts))
            holes = [i for i, x in enumerate(ids) if x is None] if None in ids else []
            for i in holes:
                ids[i] = chunks.get(parts[i])
            holes = [i for i in holes if ids[i] is None]
            if any(not parts[i] or parts[i] == FIRST or parts[i][-1].isspace() for i in holes):
                parts = self._joined(parts)
                ids = [chunks.new.get(part) for part in parts]
                holes = [i for i, x in enumerate(ids) if x is None]
            for i in holes:
                missing[parts[i]] = b""
            found.append((parts, ids, holes))
        if missing:
            spelled = {part: part[1:] if part[:1] == FIRST else " " + part for part in missing}
            learned = self._learn(list(dict.fromkeys(spelled.values())))
            for part, text in spelled.items():
                missing[part] = learned[text]
                if len(part) <= REMEMBERED_CHARS and part and not part[-1].isspace() and part != FIRST:
                    chunks.put(part, learned[text])
            for parts, ids, holes in found:
                for i in holes:
                    ids[i] = missing[parts[i]]
        return [b"".join(ids) for _, ids, _ in found]

    @staticmethod
    def _joined(parts: list[str]) -> list[str]:
        """Parts that end in white space, or are empty, joined with what follows them."""
        out, begin = [], 0
        for i, part in enumerate(parts):
            if i == len(parts) - 1 or part and not part[-1].isspace() and part != FIRST:
                out.append(" ".join(parts[begin:i + 1]))
                begin = i + 1
        return out

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """``encode`` some texts at a time, which bounds what it holds."""
        return [ids for lo, hi in blocks(texts, AT_ONCE) for ids in self.encode([t.decode() for t in texts[lo:hi]])]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


    def spell(self, ids: list[int]) -> bytes:
        """The ids in decimal, with a blank between two."""
        if not self.spelled:
            self.spelled = [str(i).encode() for i in range(len(self.tokens))]
        return b" ".join(map(self.spelled.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


@lru_cache(maxsize=2)
def coder(path: str, pattern: str, remembered: int = REMEMBERED) -> ByteBPE:
    """One coder for each worker process, rank file and table size."""
    return ByteBPE(read_ranks(path), pattern, remembered)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``ids``, the token ids of the whole text (array<int>; replaced if present).

    ``path`` is the rank file, at the same place on every machine.
    """
    ready(docs.sparkSession)
    kept = docs.drop(ids)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = coder(path, pattern)
        found = bpe.encode_batch(texts_of(batch.column(text)))
        ends = np.cumsum([0, *map(len, found)]) // 4
        values = pa.array(np.frombuffer(b"".join(found), dtype=np.int32))
        column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        return pa.record_batch([*batch.columns, column], names=schema.names)
    return map_batches(kept, run, schema)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``rows`` and ``out``, the bytes that the ids stand for (null ids: no bytes)."""
    ready(rows.sparkSession)
    kept = rows.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = coder(path, pattern)
        column = batch.column(ids)
        flat, ends = column.flatten().to_numpy(), np.cumsum([0, *column.value_lengths().fill_null(0).to_pylist()]).tolist()
        made = [bpe.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])]
        return pa.record_batch([*batch.columns, pa.array(made, pa.binary())], names=schema.names)
    return map_batches(kept, run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """All columns of ``docs`` but the text, and n_tokens, ids_sha256 and decoded_sha256 of its ids and of their bytes.

    Ids are encoded, decoded and hashed in one pass; they leave no task. ``remembered`` trades a worker's memory
    for time: new pre-tokens are merged once for as long as they are remembered.
    """
    ready(docs.sparkSession)
    made = ("n_tokens", "ids_sha256", "decoded_sha256")
    rows = docs.drop(*[c for c in made if c != text])
    kinds = (T.LongType(), T.StringType(), T.StringType())
    schema = T.StructType([*rows.drop(text).schema.fields, *map(T.StructField, made, kinds)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = coder(path, pattern, remembered)
        n, spelled, decoded = [], [], []
        for found in bpe.encode_batch(texts_of(batch.column(text))):
            ids = np.frombuffer(found, dtype=np.int32).tolist()
            n.append(len(ids))
            spelled.append(sha256(bpe.spell(ids)).hexdigest())
            decoded.append(sha256(bpe.decode(ids)).hexdigest())
        kept = [batch.column(c) for c in schema.names[:-len(made)]]
        return pa.record_batch([*kept, pa.array(n, pa.int64()), pa.array(spelled, pa.string()), pa.array(decoded, pa.string())],
                               names=schema.names)
    return map_batches(rows, run, schema)
