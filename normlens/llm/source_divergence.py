"""Source divergence audit: how far the term shares of a language's sources lie apart.

Within a language, the terms of at least ``least_docs`` documents are kept; V
is their number. A group (language, source), and the language as a whole, give
each kept term of ``count`` occurrences the share

    p = 1 + floor(SCALE * (count + 2) / (N + 2 V)),   N = all its occurrences

and two shares cost ``floor((p - q)**2 / (p + q))``. Every group is compared
with each other source of its language, summed over all kept terms, and with
the language by single terms that it uses more than the language does.

Segment trees. Kept terms of a language are dealt into blocks by hash, about
``BLOCK_TERMS`` in each, and the counts of a group over a block are a segment
tree over the block's term ids. Trees are hash-consed: a node is its two
children, and equal subtrees, of whichever group, are one node; term ids run
from the most to the least frequent term, so most groups share the subtrees of
rare terms. Two trees are walked together from their roots; of the node pairs
that a level reaches, each is kept once, leaf pairs are priced once, and prices
are added up on the way back. A block, and ``CHUNK`` sources against ``CHUNK``
sources, is one task's work, so neither a large vocabulary nor very many
sources nor a source with most rows meets in one place. All levels are numpy
arrays of node pairs; pairs of groups are taken some at a time.

All arithmetic is on integers; shares come from a long division in base 1000,
exact while N + 2 V stays below 9 * 10**15.

Edge cases: null language, source and text count as empty texts; a group
without terms still has a row for every other source, with the shares of count
zero; a language without kept terms has value 0 throughout; ties are ordered
by the bytes of the item; repeated rows count as documents of their own; long
texts are read in pieces; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normlens.llm.frames import ready, texts_of
from normlens.plans.relational import materialize

LEAST_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
BLOCK_TERMS = 4096
CHUNK = 32
#: Leaf pairs that are walked at once, so that a task's arrays stay in tens of MB.
LEAF_PAIRS = 1 << 18
#: Counted terms that a task holds before it passes them on.
HELD = 200_000
#: Bytes of a text that are split at once.
PIECE = 1 << 20

#: Bytes of terms, A-Z lower-cased; all others are blanks.
_TABLE = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_BLANK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + PIECE)  # no term is cut
        end = blank.start() if blank else len(text)
        yield text[at:end].translate(_TABLE).split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents by group, summed within tasks only.

    Each group has a row of the empty term as well, so that groups without terms are there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, documents) in held.items():
                size = len(times) + 1
                yield pa.record_batch([
                    pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()),
                    pa.array([*times, b""], pa.binary()).cast(pa.string()), pa.array([*times.values(), 0], pa.int64()),
                    pa.array([*map(documents.__getitem__, times), 0], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            held.clear()
        for batch in batches:
            names = zip(*(batch.column(c).fill_null("").to_pylist() for c in ("lang", "source")))
            for group, text in zip(names, texts_of(batch.column("text"))):
                times, documents = held.setdefault(group, (Counter(), Counter()))
                seen = set()
                for words in terms_of(text):
                    times.update(words)
                    seen.update(words)
                documents.update(seen)
            if sum(len(t) for t, _ in held.values()) > HELD:
                yield from flush()
        yield from flush()
    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), by long division; one total, or one for each count."""
    whole, rest = np.divmod(count + 2, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Forest:
    """Hash-consed segment trees of the rows of ``counts`` (trees, terms)."""

    def __init__(self, counts: np.ndarray):
        trees, terms = counts.shape
        self.height = max(0, (terms - 1).bit_length())
        padded = np.full((trees, 1 << self.height), -1, dtype=np.int64)  # -1: no term here
        padded[:, :terms] = counts
        #: Level 0 has a count for each node, the others two children.
        self.leaf, nodes = np.unique(padded, return_inverse=True)
        nodes = nodes.reshape(padded.shape)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        size = len(self.leaf)
        for _ in range(self.height):
            made, nodes = np.unique(nodes[:, 0::2] * size + nodes[:, 1::2], return_inverse=True)
            nodes = nodes.reshape(trees, -1)
            self.left.append(made // size)
            self.right.append(made % size)
            size = len(made)
        self.roots = nodes[:, 0]
        self.nodes = len(self.leaf) + sum(map(len, self.left))

    def divergence(self, first: np.ndarray, second: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Sum of prices over all terms, for pairs of trees; ``totals`` has N + 2 V of each tree."""
        step = max(1, LEAF_PAIRS >> self.height)
        return np.concatenate([self._walk(first[at:at + step], second[at:at + step], totals)
                               for at in range(0, len(first), step)]) if len(first) else np.zeros(0, np.int64)

    def _walk(self, first: np.ndarray, second: np.ndarray, totals: np.ndarray) -> np.ndarray:
        pair, a, b = np.arange(len(first)), self.roots[first], self.roots[second]
        back = []
        for level in range(self.height - 1, -1, -1):
            left, right = self.left[level], self.right[level]
            size = int(max(left.max(), right.max())) + 1
            both = np.concatenate(((pair * size + left[a]) * size + left[b], (pair * size + right[a]) * size + right[b]))
            memo, place = np.unique(both, return_inverse=True)
            back.append(place)
            pair, b = np.divmod(memo, size)
            pair, a = np.divmod(pair, size)
        x, y = self.leaf[a], self.leaf[b]
        value = np.zeros(len(pair), dtype=np.int64)
        some = x >= 0
        p, q = (shares(count[some], totals[trees[pair[some]]]) for count, trees in ((x, first), (y, second)))
        value[some] = price(p, q)
        for place in reversed(back):
            half = len(place) // 2
            value = value[place[:half]] + value[place[half:]]
        return value


def _audit_block(top: int):
    names = ["lang", "source", "part", "item", "value"]
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())

    def run(table: pa.Table) -> pa.Table:
        lang, low, high = (table.column(c)[0].as_py() for c in ("lang", "low", "high"))
        rows = list(zip(*(table.column(c).to_pylist() for c in ("source", "chunk", "term", "n", "total"))))
        whole = [(n, term) for source, _, term, n, _ in rows if source is None and term is not None]
        whole.sort(key=lambda x: (-x[0], x[1].encode()))
        at = {term: i for i, (_, term) in enumerate(whole)}
        groups = sorted({(chunk, source) for source, chunk, *_ in rows if source is not None})
        number = {source: i + 1 for i, (_, source) in enumerate(groups)}
        counts = np.zeros((len(groups) + 1, len(whole)), dtype=np.int64)
        totals = np.ones(len(groups) + 1, dtype=np.int64)
        for source, _, term, n, total in rows:
            tree = 0 if source is None else number[source]
            totals[tree] = total
            if term is not None:
                counts[tree, at[term]] = n
        chunk_of = np.array([-1, *[c for c, _ in groups]])
        if low == high:
            first, second = np.triu_indices(len(groups), 1)
            first, second = first + 1, second + 1
        else:
            first, second = (x.ravel() for x in np.meshgrid(np.flatnonzero(chunk_of == low), np.flatnonzero(chunk_of == high)))
        forest = Forest(counts) if whole else None
        value = forest.divergence(first, second, totals) if forest else np.zeros(len(first), np.int64)
        out = [(lang, groups[a - 1][1], "pair", groups[b - 1][1], v)
               for a, b, v in zip(first.tolist(), second.tolist(), value.tolist())]
        if low == high and forest:
            q = shares(counts[0], totals[0])
            for source, tree in number.items():
                used = np.flatnonzero(counts[tree])
                p = shares(counts[tree, used], totals[tree])
                used, p = used[p > q[used]], p[p > q[used]]
                cost = price(p, q[used])
                if len(cost) > top:  # what is below the top-th value of the block cannot be ranked
                    enough = np.partition(cost, len(cost) - top)[len(cost) - top]
                    used, cost = used[cost >= enough], cost[cost >= enough]
                out.extend((lang, source, "term", whole[i][1], v) for i, v in zip(used.tolist(), cost.tolist()))
        columns = list(zip(*out)) if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
    return run


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block_terms: int = BLOCK_TERMS,
          chunk: int = CHUNK) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source).

    Part ``pair``: every other source of the language. Part ``term``: the ``top``
    terms that the source uses more than its language.
    """
    ready(docs.sparkSession)
    # By group first: a frequent term then has a row for each source, not for each task and source.
    counted = materialize(term_counts(docs).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    groups, found = counted.where("term = ''").select("lang", "source"), counted.where("term <> ''")
    kept = materialize(found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs"))
                       .where(F.col("lang_docs") >= least_docs).drop("lang_docs"))
    entries = materialize(found.drop("docs").join(kept.select("lang", "term"), ["lang", "term"]))
    terms = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    languages = materialize(groups.groupBy("lang").agg(F.count("*").alias("groups")).join(terms, "lang", "left").na.fill(0).selectExpr(
        "lang", "v", "lang_total + 2 * v AS lang_total", f"int(ceil(greatest(v, 1) / {block_terms})) AS blocks",
        f"int(ceil(groups / {chunk})) AS chunks"))
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    totals = materialize(groups.join(languages, "lang").join(own, ["lang", "source"], "left").selectExpr(
        "lang", "source", "coalesce(n, 0) + 2 * v AS total", "blocks", "chunks", "int(pmod(xxhash64(source), chunks)) AS chunk"))

    block = F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    none = F.lit(None).cast("string").alias("term")
    mine = ("lang", "source", "chunk", "chunks", "total")
    of_groups = (
        entries.join(totals, ["lang", "source"]).select(*mine, block, "term", "n")
        .unionByName(totals.select(*mine, every, none, F.lit(0).cast("long").alias("n"))))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    sent = of_groups.select("*", other).select(
        "lang", "source", "chunk", "total", "block", "term", "n", F.least("chunk", "other").alias("low"),
        F.greatest("chunk", "other").alias("high"))
    # The language's own tree goes to every pair of chunks.
    lower = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("low")
    upper = F.explode(F.sequence(F.col("low"), F.col("chunks") - 1)).alias("high")
    of_language = kept.join(languages, "lang").select(
        "lang", "lang_n", "lang_total", "chunks", block, "term", lower).select("*", upper).select(
        "lang", F.lit(None).cast("string").alias("source"), F.lit(-1).alias("chunk"), F.col("lang_total").alias("total"),
        "block", "term", F.col("lang_n").alias("n"), "low", "high")
    priced = sent.unionByName(of_language).groupBy("lang", "block", "low", "high").applyInArrow(
        _audit_block(top), "lang string, source string, part string, item string, value long")
    priced = materialize(priced)

    pairs = priced.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", sides.alias("s"), "part", "value").select("lang", "s.source", "part", "s.item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    place = F.row_number().over(order).alias("rank")
    best = priced.where("part = 'term'").select("*", place).where(F.col("rank") <= top)
    return pairs.select("*", place).unionByName(best)
