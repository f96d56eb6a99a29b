"""Near-duplicate groups by SimHash fingerprints and BK-trees.

Fingerprint. A-Z are lower-cased, words are runs other than space and
0x09-0x0D, shingles are ``size`` words joined by a space, repeats included
(fewer words: the whole sequence). A bit of the fingerprint is set if it is
set in over half of the shingles' XXH64 values (seed 42). A text without words
has fingerprint zero, linked like any other.

Links. Fingerprints at ``radius`` or fewer differing bits are linked; groups
are the components. Two such fingerprints agree in at least one of
``radius + 1`` equal blocks of bits, so each distinct fingerprint is sent to
one shard for each block's value and a BK-tree of the shard is searched:
children are keyed by their Hamming distance to the parent, and only edges
within the radius of the query's distance are followed. A shard passes on the
links of a spanning forest, never all pairs. Shard trees are built where the
shard's rows are, not broadcast: a shard holds only fingerprints that share a
block, which is what keeps the search from growing with the square of the
corpus.

Large shards. A shard of more than ``shard_rows`` fingerprints is split by the
same rule on its other bits; one that is still larger (a dense group of near
copies) is dealt into chunks, and every pair of chunks is one shard. Nothing
is dropped.

Edge cases: null and empty texts have fingerprint zero; null ids take part and
get the smallest id of their group (null if it has none); repeated rows and
ids are separate rows of one group if their fingerprints are; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from normlens.llm.components import components
from normlens.llm.frames import free_names, keyed, map_batches, ready, texts_of
from normlens.plans.relational import materialize

SEED = 42
BITS = 64
#: Fingerprints in one shard tree.
SHARD_ROWS = 1500

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: For a byte, eight counters of one byte each, the highest bit first.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def shingle_hashes(text: bytes, size: int) -> bytes:
    """The 8-byte XXH64 values, high byte first, of a text's shingles."""
    words = text.translate(_LOWER).split()
    if not words:
        return b""
    joined = b" ".join(words)
    if len(words) <= size:
        return xxh64_digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return b"".join([xxh64_digest(joined[a:b], SEED)
                     for a, b in zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())])


def fingerprints(texts: list[bytes], size: int) -> np.ndarray:
    """Signed 64-bit fingerprints."""
    out = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        hashes = np.frombuffer(shingle_hashes(text, size), dtype=np.uint8).reshape(-1, 8)
        if len(hashes):
            # A counter of one byte holds 255 shingles.
            parts = np.add.reduceat(_LANES[hashes], np.arange(0, len(hashes), 255), axis=0)
            ones = parts.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(ones * 2 > len(hashes)).view(">i8")[0]
    return out


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self) -> None:
        self.children: dict[int, dict[int, int]] = {}
        self.root: int | None = None

    def insert(self, value: int) -> None:
        if self.root is None:
            self.root, self.children[value] = value, {}
            return
        at = self.root
        while at != value:
            distance = (at ^ value).bit_count()
            below = self.children[at].get(distance)
            if below is None:
                self.children[at][distance] = value
                self.children[value] = {}
                return
            at = below

    def within(self, value: int, radius: int) -> Iterator[int]:
        todo = [] if self.root is None else [self.root]
        while todo:
            at = todo.pop()
            distance = (at ^ value).bit_count()
            if distance <= radius:
                yield at
            for edge, child in self.children[at].items():
                if distance - radius <= edge <= distance + radius:
                    todo.append(child)


def shard_links(tree_rows: list[int], query_rows: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (member, head) of a spanning forest over a shard's tree and the queries against it.

    Each tree row is also a query against the rows before it.
    """
    head: dict[int, int] = {}

    def find(x: int) -> int:
        while head.setdefault(x, x) != x:
            head[x] = head[head[x]]
            x = head[x]
        return x
    tree = BKTree()
    for rows, insert in ((tree_rows, True), (query_rows, False)):
        for value in rows:
            for near in tree.within(value, radius):
                head[find(value)] = find(near)
            if insert:
                tree.insert(value)
    return [(x, find(x)) for x in head if find(x) != x]


def _bits(column: F.Column, lo: int, width: int) -> F.Column:
    return F.shiftrightunsigned(column, lo).bitwiseAND(F.lit((1 << width) - 1))


def _without(column: F.Column, lo: int, width: int) -> F.Column:
    """The bits of a value without a block of them."""
    low = column.bitwiseAND(F.lit((1 << lo) - 1)) if lo else F.lit(0).cast("long")
    high = F.shiftleft(F.shiftrightunsigned(column, lo + width), lo) if lo + width < BITS else F.lit(0).cast("long")
    return high.bitwiseOR(low)


def _shards(distinct: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """(shard, a, b, c, fp): rows of chunk c = a are the tree of a shard, those of chunk c = b its queries."""
    fp, pieces = F.col("fp"), radius + 1
    width = BITS // pieces
    fine = (BITS - width) // pieces
    blocks = F.array(*[F.struct((F.lit(i << width) + _bits(fp, i * width, width)).alias("shard"),
                                _without(fp, i * width, width).alias("rest")) for i in range(pieces)])
    coarse = distinct.select("fp", F.inline(blocks))
    # At most pieces * 2**width shards, whatever the number of rows.
    large = coarse.groupBy("shard").count().where(F.col("count") > shard_rows).select("shard")
    large = materialize(large)
    large = F.broadcast(large) if width <= 16 else large
    small = coarse.join(large, "shard", "left_anti").select("shard", "fp", F.lit(1).alias("chunks"))
    blocks = F.array(*[F.lit(i << fine) + _bits(F.col("rest"), i * fine, fine) for i in range(pieces)])
    split = (coarse.join(large, "shard", "left_semi").select("fp", "shard", F.explode(blocks).alias("block"))
             .select((F.lit(pieces << width) + F.col("shard") * (pieces << fine) + F.col("block")).alias("shard"), "fp"))
    dense = split.groupBy("shard").count().where(F.col("count") > shard_rows)
    dense = materialize(dense.select("shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("more")))
    split = split.join(dense, "shard", "left").select("shard", "fp", F.coalesce("more", F.lit(1)).alias("chunks"))
    return (small.unionByName(split)
            .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
            .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
            .select("shard", F.least("c", "other").alias("a"), F.greatest("c", "other").alias("b"), "c", "fp"))


def _search(radius: int):
    half, mask = 1 << (BITS - 1), (1 << BITS) - 1

    def signed(links: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*links)
        return pa.record_batch([pa.array([(x ^ half) - half for x in side], pa.int64()) for side in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree, queries, links = None, [], [], []
        for batch in batches:
            for shard, a, b, c, fp in zip(*(column.to_pylist() for column in batch.columns)):
                if (shard, a, b) != last:
                    if len(tree) + len(queries) > 1:
                        links += shard_links(tree, queries, radius)
                    last, tree, queries = (shard, a, b), [], []
                (tree if c == a else queries).append(fp & mask)
            if len(links) > 10_000:
                yield signed(links)
                links = []
        if len(tree) + len(queries) > 1:
            links += shard_links(tree, queries, radius)
        if links:
            yield signed(links)
    return run


def fingerprint_links(distinct: DataFrame, radius: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): links whose components are those of all pairs of fingerprints within the radius.

    ``distinct`` has one long column fp without repeats. ``radius`` is 1 to 15.
    """
    shards = _shards(distinct, radius, shard_rows)
    return (shards.repartition("shard", "a", "b").sortWithinPartitions("shard", "a", "b", "c", "fp")
            .select("shard", "a", "b", "c", "fp").mapInArrow(_search(radius), "a long, b long"))


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, _k1, _k2, fp, component_id, kept): one row per document; kept marks the group's one representative.

    component_id is the smallest doc_id of the group. The representative has
    that id (of rows with one id, the smallest text hash); its exact
    repetitions are marked too.
    """
    ready(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = pa.array(fingerprints(texts_of(batch.column("text")), size))
        return pa.record_batch([batch.column(c) for c in ("doc_id", "_k1", "_k2")] + [fp], names=["doc_id", "_k1", "_k2", "fp"])
    rows = materialize(map_batches(keyed(docs.select("doc_id", "text")).select("doc_id", "text", "_k1", "_k2"), run,
                                   "doc_id long, _k1 long, _k2 long, fp long"))
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_k2")).alias("least")
    distinct = materialize(rows.groupBy("fp").agg(first))
    roots = components(fingerprint_links(distinct.select("fp"), radius, shard_rows)).withColumnsRenamed({"v": "fp"})
    rooted = materialize(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    heads = materialize(rooted.groupBy("root").agg(F.min("least").alias("head")))
    heads = materialize(rooted.select("fp", "root").join(heads, "root").select("fp", "head"))
    return rows.join(heads, "fp").select(
        "doc_id", "_k1", "_k2", "fp", F.col("head.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("_k2") == F.col("head._k2"))).alias("kept"))


def keep_one(docs: DataFrame, size: int = 3, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that represent their group of near copies; one row for each group."""
    names = free_names(docs, "_k1", "_k2")
    chosen = near_duplicates(docs.select("doc_id", "text"), size, radius, shard_rows).where("kept").select("_k1", "_k2").distinct()
    return (keyed(docs, names=names).join(chosen.toDF(*names), names, "left_semi")
            .dropDuplicates(names).select(docs.columns))
