"""Benchmark decontamination by latent semantic retrieval and order checks.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased.
A passage is ``PASSAGE`` words of a text, every half passage. Items of few words
are sought in shorter passages, the longest of ``PASSAGE`` / 2, / 4, ... that
they nearly fill half of, by a run of their own. The terms are
the words of the benchmark; the words of a passage that are no terms count in
its length with the mean weight of the terms.

1. Document frequencies of the terms over all passages of all texts give the
   weights log((passages + 1) / (frequency + 1))**2; the square sets the rare
   terms of an item apart from those that any text has. A term next to a word
   that it also stands next to in an item is not counted, so that an item weighs
   the same however often it leaks. A term that few items hold, or an item too light
   without it, weighs ``FLOOR`` of the mean at least, so that an item that nearly
   fills half of a passage reaches the cosine among any other words. A term counts with the root of its times in a passage: words
   add up in the squared length, and none gains by repetition.
2. A passage whose terms make up less than ``cosine``**2 of its squared length
   cannot reach that cosine with any item, so only the others are kept.
3. A randomised SVD gives the latent space. The matrix A has the TF-IDF rows of
   all kept passages. The items' passages and ``EXTRA`` random directions, ``RANK``
   together at least, are multiplied by A'A, task by task, and the sums of all
   tasks are made orthonormal, ``ROUNDS`` times. This gives singular directions
   beside each item, also where other topics of the corpus are heavier (beyond
   ``SEEDS`` passages, neighbours begin as one). A last pass sums A'A within
   these, which weighs them by their squared values. What the items have outside
   them is appended, so the space holds every item however many corpus rows there are.
4. In this space each kept passage is compared with two points for each passage
   of an item: the passage itself, and its image by A'A within the singular
   directions alone, which has weight on the words that the corpus uses beside
   those of the item, whatever other items have them. An image counts if its
   cosine with its own item reaches the given one. A pair's cosine is that with
   the nearest direction from the item to its image. Towards the item it is that
   of the TF-IDF rows, as the space holds the items, so no pair has less; it is
   higher where a paraphrase puts such words for those of the item. Pairs with
   at least the given cosine are candidates, without any cap on their number.
5. A candidate is a leak if the longest common subsequence of the item and the
   passage with its surroundings covers ``covered`` of the item, or
   ``paraphrase`` of it and ``answer`` of the item's answer, its last sentence
   (its last third if there is only one).

The benchmark is taken in blocks of ``BLOCK_ITEMS``, each a bounded broadcast.

Edge cases: null and empty texts and items have no passages or terms and match
nothing; an item of one word leaks wherever that word stands; texts shorter than a passage are one passage; repeated rows match
each by itself; repeated items match alike; null ids pass through; empty
tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.llm.frames import free_names, keyed, map_batches, ready, texts_of
from normlens.llm.words import WordTable, blocks
from normlens.plans.relational import materialize

PASSAGE = 32
COSINE = 0.45
#: Least weight, as a share of the mean, of a term that at most one in RARE_ITEMS items (or one item) holds.
FLOOR = 0.55
RARE_ITEMS = 50
COVERED = 0.75
PARAPHRASE = 0.55
ANSWER = 0.8
#: Least number of singular directions.
RANK = 128
#: Random directions beside those that begin as passages of the items, and the most of the latter.
EXTRA = 32
SEEDS = 512
ROUNDS = 2
BLOCK_ITEMS = 256
#: Partitions of kept passages whose sums one task makes.
SUM_PARTITIONS = 4
#: Rows whose products are made at a time, so that these stay in the processor's cache.
CHUNK = 128
#: Rows whose parts of A'A are added at a time.
GRAM_CHUNK = 8192
#: Groups of tasks whose sums are added first.
SHARES = 16
#: Terms whose sums travel together.
TERM_BLOCK = 128

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_SCREEN_BITS = 20


@dataclass
class Items:
    """A block of the benchmark: ids, term numbers in order, and where each answer begins."""
    ids: list
    words: list[np.ndarray]
    answer: list[int]
    terms: np.ndarray
    passage: int = PASSAGE

    def passages(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The items' passages, as those of texts, and the item of each."""
        size, step = self.passage, self.passage // 2
        made = [(w[lo:lo + size], i) for i, w in enumerate(self.words) for lo in range(0, max(1, len(w) - size + step), step)]
        return [w for w, _ in made], np.array([i for _, i in made])

    def pairs(self) -> np.ndarray:
        """Pairs of words that stand side by side in an item, sorted."""
        return np.unique(np.concatenate([_pair(w) for w in self.words]))

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for others."""
        if not hasattr(self, "_screen"):
            self._screen = np.zeros(1 << _SCREEN_BITS, dtype=bool)
            self._screen[self.terms >> np.uint64(64 - _SCREEN_BITS)] = True
        out = np.full(len(hashes), -1, dtype=np.int32)
        hit = np.flatnonzero(self._screen[hashes >> np.uint64(64 - _SCREEN_BITS)])
        place = np.minimum(np.searchsorted(self.terms, hashes[hit]), len(self.terms) - 1)
        good = self.terms[place] == hashes[hit]
        out[hit[good]] = place[good]
        return out


def _pair(term: np.ndarray) -> np.ndarray:
    return term[:-1].astype(np.int64) << 32 | term[1:]


def passage_words(words: int) -> int:
    """Words of the passages that an item of so many words is sought in, so that it makes up 0.45 of one at least."""
    size = PASSAGE
    while size > 2 and 11 * words < 5 * size:
        size //= 2
    return size


def by_passage(rows: list[tuple]) -> list[Items]:
    """The items of (item_id, text) rows, apart by the passages that they are sought in."""
    texts = [(text or "").encode() for _, text in rows]
    count = WordTable(texts or [b""], lower=True, member=_WORD).n.tolist()
    classes: dict[int, list[tuple]] = {}
    for row, n in zip(rows, count):
        if n:
            classes.setdefault(passage_words(n), []).append(row)
    return [read_items(some, size) for size, some in sorted(classes.items())]


def read_items(rows: list[tuple], passage: int = PASSAGE) -> Items:
    """From (item_id, text) rows."""
    rows = [(i, (text or "").encode()) for i, text in rows]
    texts = [t for _, t in rows]
    table = WordTable(texts or [b""], lower=True, member=_WORD)
    terms, number = np.unique(table.hash, return_inverse=True)
    ids, words, answer = [], [], []
    for d, (item, text) in enumerate(rows):
        own = number[table.first[d]:table.first[d + 1]].astype(np.int32)
        if not len(own):
            continue
        ends = [m.end() for m in re.finditer(rb"[.?!]+\s+", text.rstrip())]
        starts = table.start[table.first[d]:table.first[d + 1]] - table.text_start[d]
        begin = int(np.searchsorted(starts, ends[-1])) if ends else 0
        ids.append(item)
        words.append(own)
        answer.append(begin if 0 < begin < len(own) else len(own) * 2 // 3)
    return Items(ids, words, answer, terms, passage)


def _passages(table: WordTable, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of every passage of so many words, counted from the block's first word."""
    step = words // 2
    count = np.where(table.n > 0, np.maximum(1, -(-(table.n - step) // step)), 0)
    text = np.repeat(np.arange(len(table.n)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = table.first[text] + place * step
    return first, np.minimum(words, table.first[text + 1] - first), text


def _cells(term: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, times) of the terms in each passage, by passage and term."""
    # Words that are terms, found for each passage by their rank among all terms.
    place = np.flatnonzero(term >= 0)
    lo, hi = np.searchsorted(place, first), np.searchsorted(place, first + size)
    n = hi - lo
    passage = np.repeat(np.arange(len(first)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    cell, times = np.unique(passage.astype(np.int64) << 32 | term[place[at]], return_counts=True)
    return cell >> 32, cell & 0xFFFFFFFF, times


def _own_words(term: np.ndarray, table: WordTable, pairs: np.ndarray) -> np.ndarray:
    """The terms, -1 for those beside a word that they stand beside in an item too."""
    if len(term) < 2:
        return term
    both = np.flatnonzero((term[:-1] >= 0) & (term[1:] >= 0))
    ends = np.zeros(len(term) + 1, dtype=bool)
    ends[table.first] = True  # the first words of texts
    pair = term[both].astype(np.int64) << 32 | term[both + 1]
    place = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
    hit = both[(pairs[place] == pair) & ~ends[both + 1]] if len(pairs) else both[:0]
    out = term.copy()
    out[hit] = out[hit + 1] = -1
    return out


def term_weights(items: Items, frequency: np.ndarray, passages: int, cosine: float = COSINE) -> np.ndarray:
    idf = np.log((passages + 1) / (frequency + 1)) ** 2 + 1e-3
    held = np.bincount(np.concatenate([np.unique(w) for w in items.words]), minlength=len(items.terms))
    few = held <= max(1, len(items.words) // RARE_ITEMS)
    out = idf
    while True:
        for _ in range(40):  # the floor follows the mean that it raises
            out = np.maximum(idf, few * FLOOR * out.mean())
        low = [w for w in items.words if not few[w].all() and not _enough(out[w], items.passage, out.mean(), cosine)]
        if not low:
            return out
        few[np.concatenate(low)] = True


def _enough(weights: np.ndarray, passage: int, other: float, cosine: float) -> bool:
    """Whether an item's words reach the cosine in a passage that other words fill; 5/8 of one may be all that a passage has of them."""
    n = min(len(weights), passage * 5 // 8 or 1)
    return (1 - cosine**2) * (weights**2).mean() * n >= cosine**2 * (passage - n) * other**2


def document_frequencies(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """Passages with each term outside the items' word pairs, and passages, over all texts."""
    pairs = items.pairs()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, seen = np.zeros(len(items.terms) + 1, dtype=np.int64), 0
        texts = texts_of(batch.column("text"))
        for lo, hi in blocks(texts):
            table = WordTable(texts[lo:hi], lower=True, member=_WORD)
            first, size, _ = _passages(table, items.passage)
            term = _own_words(items.lookup(table.hash), table, pairs)
            total[:-1] += np.bincount(_cells(term, first, size)[1], minlength=len(items.terms))
            seen += len(first)
        total[-1] = seen
        some = np.flatnonzero(total)
        return pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "n"])
    rows = map_batches(docs.select("text"), run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(items.terms) + 1, dtype=np.int64)
    for r in rows:  # one row for each term of the block
        out[r.term] = r.n
    return out[:-1], int(out[-1])


def kept_passages(docs: DataFrame, items: Items, idf: np.ndarray, cosine: float) -> DataFrame:
    """(doc_id, _k1, _k2, start, inside, around, length): passages that may reach the cosine.

    inside and around are term numbers (int32 in bytes, -1 for other words) of
    the passage and of it with the words near it; length is that of the vector.
    """
    rare, near = float(idf.mean()), max(map(len, items.words))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts, out = texts_of(batch.column("text")), []
        for lo, hi in blocks(texts):
            table = WordTable(texts[lo:hi], lower=True, member=_WORD)
            first, size, text = _passages(table, items.passage)
            if not len(first):
                continue
            term = items.lookup(table.hash)
            passage, cell, times = _cells(term, first, size)
            known = np.bincount(passage, times, minlength=len(first))
            inner = np.bincount(passage, times * idf[cell] ** 2, minlength=len(first))
            length = inner + (size - known) * rare**2
            for p in np.flatnonzero((inner > 0) & (inner >= cosine**2 * length)).tolist():
                a, d = int(first[p]), int(text[p])
                around = term[max(table.first[d], a - near):min(table.first[d + 1], a + size[p] + near)]
                out.append((lo + d, a - int(table.first[d]), term[a:a + size[p]].tobytes(), around.tobytes(),
                            float(np.sqrt(length[p]))))
        if not out:
            return None
        row, start, inside, around, length = zip(*out)
        take = pa.array(row)
        return pa.record_batch([*(batch.column(c).take(take) for c in ("doc_id", "_k1", "_k2")), pa.array(start, pa.int64()),
                                pa.array(inside, pa.binary()), pa.array(around, pa.binary()), pa.array(length, pa.float64())],
                               names=["doc_id", "_k1", "_k2", "start", "inside", "around", "length"])
    return map_batches(docs.select("doc_id", "_k1", "_k2", "text"), run,
                       "doc_id long, _k1 long, _k2 long, start long, inside binary, around binary, length double")


def _sparse(inside: list[bytes], idf: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, value) of normalised TF-IDF rows."""
    term = np.frombuffer(b"".join(inside), dtype=np.int32)
    row = np.repeat(np.arange(len(inside)), [len(x) // 4 for x in inside])
    cell, times = np.unique(row[term >= 0].astype(np.int64) << 32 | term[term >= 0], return_counts=True)
    row, term = cell >> 32, cell & 0xFFFFFFFF
    return row, term, np.sqrt(times) * idf[term] / length[row]


def _times(row: np.ndarray, column: np.ndarray, value: np.ndarray, dense: np.ndarray, rows: int) -> np.ndarray:
    """A sparse matrix, ordered by row, times a dense one, whose rows lie one after another."""
    out = np.zeros((rows, dense.shape[1]), dtype=dense.dtype)
    cut = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))).tolist()
    value = value.astype(dense.dtype)
    for i, (a, b) in enumerate(zip(cut, cut[1:])):
        if a < b:  # what one row needs stays in the processor's cache
            np.dot(value[a:b], dense.take(column[a:b], axis=0), out=out[i])
    return out


def _projected(inside: list[bytes], length: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, coordinates) of some rows after others."""
    for lo in range(0, len(inside), CHUNK):
        some = inside[lo:lo + CHUNK]
        yield lo, _times(*_sparse(some, idf, length[lo:lo + CHUNK]), basis, len(some))


def _gram(inside: list[bytes], length: np.ndarray, idf: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """A'A times the directions, for the rows given."""
    out = np.zeros(directions.shape)
    for lo in range(0, len(inside), GRAM_CHUNK):
        row, term, value = _sparse(inside[lo:lo + GRAM_CHUNK], idf, length[lo:lo + GRAM_CHUNK])
        seen = _times(row, term, value, directions, len(length[lo:lo + GRAM_CHUNK]))
        order = np.argsort(term, kind="stable")
        out += _times(term[order], row[order], value[order], seen, len(directions))
    return out


def _inner(inside: list[bytes], length: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A within the space, for the rows given."""
    out = np.zeros((basis.shape[1], basis.shape[1]))
    for _, seen in _projected(inside, length, idf, basis):
        out += seen.T @ seen
    return out


def _partial_sums(passages: DataFrame, idf: np.ndarray, basis: np.ndarray, product: Callable[..., np.ndarray] = _gram) -> DataFrame:
    """(block, share, sums): each task's part of A'A times the directions (or another product), for the rows of ``passages``.

    A task that runs again emits the same keys, as share follows from its partition.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, inside, length = None, [], []

        def add() -> None:
            nonlocal total
            made = product(inside, np.concatenate(length), idf, basis)
            if total is None:
                total = made
            else:
                total += made
            inside.clear()
            length.clear()
        for batch in batches:
            inside += batch.column("inside").to_pylist()
            length.append(batch.column("length").to_numpy())
            if len(inside) >= GRAM_CHUNK:
                add()
        if inside:
            add()
        if total is not None:
            parts = [total[lo:lo + TERM_BLOCK].tobytes() for lo in range(0, len(total), TERM_BLOCK)]
            share = TaskContext.get().partitionId() % SHARES
            yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array([share] * len(parts), pa.int32()),
                                   pa.array(parts, pa.binary())], names=["block", "share", "sums"])
    return passages.mapInArrow(partial, "block int, share int, sums binary")


def _summed(passages: DataFrame, idf: np.ndarray, basis: np.ndarray, rows: int, product: Callable[..., np.ndarray] = _gram) -> np.ndarray:
    """The product over all rows of ``passages``, a matrix of so many rows."""
    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=np.float64) for x in group.column("sums").to_pylist())
        return pa.table({"block": group.column("block").slice(0, 1), "share": group.column("share").slice(0, 1),
                         "sums": pa.array([total.tobytes()], pa.binary())})
    schema = "block int, share int, sums binary"
    some = passages.select("inside", "length")
    some = some.coalesce(max(1, -(-some.rdd.getNumPartitions() // SUM_PARTITIONS)))
    # Two levels, so that no task adds up what all others have made.
    sums = _partial_sums(some, idf, basis, product).groupBy("block", "share").applyInArrow(add, schema)
    sums = sums.groupBy("block").applyInArrow(add, schema)
    total = np.zeros((rows, basis.shape[1]))
    for r in sums.collect():  # one matrix of (terms of the block of items, or rank) x rank
        lo = r.block * TERM_BLOCK
        total[lo:lo + TERM_BLOCK] += np.frombuffer(r.sums, dtype=np.float64).reshape(-1, basis.shape[1])
    return total


def directions_for(items: Items) -> int:
    """How many singular directions are sought for a block of items."""
    return min(len(items.terms), max(RANK, min(SEEDS, len(items.passages()[0])) + EXTRA))


def singular_directions(passages: DataFrame, idf: np.ndarray, rank: int = RANK, rounds: int = ROUNDS, seed: int = 17,
                        start: np.ndarray | None = None) -> np.ndarray:
    """Orthonormal (terms, at most rank): the leading right singular vectors of the passages, by randomised subspace iteration.

    It begins with the columns of ``start``, if any, and random ones up to the rank.
    """
    first = np.random.default_rng(seed).normal(size=(len(idf), min(rank, len(idf)) - (0 if start is None else start.shape[1])))
    basis = _span(first if start is None else np.concatenate((start, first / np.sqrt(len(idf))), axis=1))
    for _ in range(rounds):
        if basis.shape[1]:  # none are left if no passage is kept
            basis = _span(_summed(passages, idf, basis.astype(np.float32, order="C"), len(idf)))
    return basis


def latent_basis(passages: DataFrame, items: Items, idf: np.ndarray, rounds: int = ROUNDS, seed: int = 17) -> np.ndarray:
    """Orthonormal (terms, width) basis: the singular directions of the passages, then what these leave of the items.

    The directions begin as the items, for the leading ones of a large corpus have little of any item.
    """
    own = _dense(items.passages()[0], idf)
    rank = directions_for(items)
    seeds = min(own.shape[1], SEEDS, rank)
    start = np.add.reduceat(own, np.arange(seeds) * own.shape[1] // seeds, axis=1)
    leading = singular_directions(passages, idf, rank, rounds, seed, start)
    return np.concatenate((leading, _outside(leading, own)), axis=1)


def corpus_product(passages: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A of the passages within the basis, in its coordinates."""
    return _summed(passages, idf, basis.astype(np.float32, order="C"), basis.shape[1], _inner)


def images(items: np.ndarray, product: np.ndarray, cosine: float = COSINE) -> np.ndarray:
    """Unit images by A'A of what the singular directions have of unit rows; zero where an image is farther from its row than the cosine."""
    out = items @ product
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return np.where((items * out).sum(axis=1, keepdims=True) >= cosine, out, 0)


def nearest_cosine(item: np.ndarray, image: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Greatest cosine with a direction from the item to its image, from those with both and that between them."""
    between = (item > image * apart) & (image > item * apart) & (apart < 0.999)  # nearer, they are as good as one
    plane = np.sqrt(np.maximum(item**2 + image**2 - 2 * item * image * apart, 0) / np.maximum(1 - apart**2, 1e-6))
    return np.where(between, np.minimum(plane, 1), np.maximum(item, image))


def _dense(rows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """(terms, rows) of the normalised TF-IDF rows."""
    row, term, value = _sparse([w.tobytes() for w in rows], idf, _lengths(rows, idf))
    out = np.zeros((len(idf), len(rows)))
    out[term, row] = value
    return out


def _span(columns: np.ndarray) -> np.ndarray:
    """Orthonormal basis of the span of all columns."""
    left, size, _ = np.linalg.svd(columns, full_matrices=False)
    return left[:, size > 1e-9 * size[0]]


def _outside(span: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Orthonormal basis of what the span leaves of the directions."""
    whole = np.linalg.norm(directions)
    for _ in range(2):  # the second time takes the rounding error of the first
        directions = directions - span @ (span.T @ directions)
        left, size, _ = np.linalg.svd(directions, full_matrices=False)
        directions = left[:, size > 1e-9 * whole]
        whole = 1.0
    return directions


def _lengths(rows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    out = []
    for w in rows:
        term, times = np.unique(w, return_counts=True)
        out.append(max(float(np.sqrt((times * idf[term] ** 2).sum())), 1e-9))
    return np.array(out)


def common_words(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Bits (one for each item word) outside which the longest common subsequence lies; see ``covered_words``."""
    full = (1 << size) - 1
    state = full
    for word in words:
        mask = masks.get(word)
        if mask:
            hit = state & mask
            state = ((state + hit) | (state - hit)) & full
    return state


def covered_words(item: np.ndarray, words: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    masks: dict[int, int] = {}
    for place, word in enumerate(item.tolist()):
        masks[word] = masks.get(word, 0) | 1 << place
    return len(item) - common_words(masks, len(item), words).bit_count()


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, covered: float = COVERED,
               paraphrase: float = PARAPHRASE, answer: float = ANSWER) -> DataFrame:
    """(doc_id, _k1, _k2, item_id, cosine, lcs, answer_lcs): one row for each text row and item that it leaks.

    The last three are the best values over the text's passages. ``docs`` has
    doc_id and text, ``benchmark`` item_id and text.
    """
    spark = ready(docs.sparkSession)
    rows = keyed(docs.select("doc_id", "text")).select("doc_id", "text", "_k1", "_k2")
    items = benchmark.select("item_id", "text")
    parts = max(1, -(-items.count() // BLOCK_ITEMS))
    found = None
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        for some in by_passage([tuple(r) for r in mine]):
            leaks = _leaks_of(rows, some, cosine, covered, paraphrase, answer)
            found = leaks if found is None else found.unionByName(leaks)
    if found is None:
        found = spark.createDataFrame([], _LEAKS)
    return found.groupBy("doc_id", "_k1", "_k2", "item_id").agg(
        F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer_lcs").alias("answer_lcs"))


_LEAKS = "doc_id long, _k1 long, _k2 long, item_id long, cosine double, lcs double, answer_lcs double"


def _leaks_of(rows: DataFrame, items: Items, cosine: float, covered: float, paraphrase: float, answer: float) -> DataFrame:
    frequency, passages = document_frequencies(rows, items)
    idf = term_weights(items, frequency, passages, cosine)
    kept = materialize(kept_passages(rows, items, idf, cosine))
    basis = latent_basis(kept, items, idf)
    queries, owner = items.passages()
    latent = _times(*_sparse([w.tobytes() for w in queries], idf, _lengths(queries, idf)), basis, len(queries))
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    rank = min(directions_for(items), basis.shape[1])  # the singular directions come first; others have no passages if these are fewer
    image = images(latent[:, :rank], corpus_product(kept, idf, basis[:, :rank]), cosine)
    apart = (latent[:, :rank] * image).sum(axis=1).astype(np.float32)
    # The items as the space holds them, beside the singular directions: one product gives both.
    points = np.concatenate((basis[:, :rank], basis @ latent.T), axis=1).astype(np.float32, order="C")
    image = image.T.astype(np.float32, order="C")
    # A direction between two is no nearer than the better of them by more than half their angle.
    least = (cosine * np.sqrt((1 + apart) / 2) * (1 - 1e-6)).astype(np.float32)
    item_words, item_ids, begins = items.words, items.ids, items.answer

    def search(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out, inside = [], batch.column("inside").to_pylist()
        around, length = batch.column("around").to_pylist(), batch.column("length").to_numpy()
        near: dict[tuple[int, int], float] = {}  # the best passage of each item
        for lo, seen in _projected(inside, length, idf, points):
            own, other = seen[:, rank:], seen[:, :rank] @ image
            some = np.nonzero(np.maximum(own, other) >= least)
            best = nearest_cosine(own[some], other[some], apart[some[1]])
            for p, i, x in zip((some[0] + lo).tolist(), owner[some[1]].tolist(), best.tolist()):
                if x >= cosine and x > near.get((p, i), 0):
                    near[p, i] = x
        for (p, i), x in near.items():
            words = [w for w in np.frombuffer(around[p], dtype=np.int32).tolist() if w >= 0]
            item, begin = item_words[i], begins[i]
            whole = covered_words(item, words) / len(item)
            if whole < min(covered, paraphrase):
                continue
            end = covered_words(item[begin:], words) / max(1, len(item) - begin)
            if whole >= covered or end >= answer:
                out.append((p, item_ids[i], x, whole, end))
        if not out:
            return None
        row, item, near, whole, end = zip(*out)
        take = pa.array(row)
        return pa.record_batch([*(batch.column(c).take(take) for c in ("doc_id", "_k1", "_k2")), pa.array(item, pa.int64()),
                                pa.array(near, pa.float64()), pa.array(whole, pa.float64()), pa.array(end, pa.float64())],
                               names=["doc_id", "_k1", "_k2", "item_id", "cosine", "lcs", "answer_lcs"])
    return map_batches(kept.select("doc_id", "_k1", "_k2", "inside", "around", "length"), search, _LEAKS)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **limits: float) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item of the benchmark."""
    names = free_names(docs, "_k1", "_k2")
    leaking = materialize(find_leaks(docs, benchmark, **limits).select("_k1", "_k2").distinct())
    return keyed(docs, names=names).join(leaking.toDF(*names), names, "left_anti").select(docs.columns)
