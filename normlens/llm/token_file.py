"""Token-id output: fixed-width bit packing with block offsets.

A file image holds the ids of whole documents, each id in ``bits`` bits, the
fewest that the vocabulary needs, lowest bit first. Eight ids take ``bits``
bytes, so packing and unpacking are a few operations on columns of bytes. Ids
stand in blocks of ``block`` ids, a multiple of eight; each block begins at the
byte that the block table names, so any document is read without the others:

    b"NLPK", uint32 bits, uint32 block, uint64 documents, uint64 ids,
    int64[documents] doc_id, uint64[documents + 1] first id of each document,
    uint64[blocks + 1] byte at which each block begins, the packed blocks

All numbers are little-endian. A null doc_id is stored as the lowest int64.

``write`` encodes a table, orders it by doc_id (ties by the hash of the text),
and stores file images of about ``IMAGE_IDS`` ids as rows of a Parquet table,
with the place of each in the whole sequence. Parquet is only the container,
so that any store that Spark reaches will do; ``save`` and ``open_image`` put
single images in plain files. ``read`` gives the ids back.

Edge cases: null and empty texts have only the end id; a text is never split
over images, so one longer than an image makes a larger one; repeated ids and
rows are separate documents; an empty table gives a table without images.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlens.llm.byte_bpe import REMEMBERED_CHARS
from normlens.llm.frames import ready, release, texts_of
from normlens.llm.words import SPACES, byte_set
from normlens.plans.relational import shared_folder

MAGIC = b"NLPK"
BLOCK = 4096
IMAGE_IDS = 1_000_000
#: Ids that are packed at a time, so that these stay in the processor's cache.
PACKED = 1 << 16
#: Words that go to the library as one text.
TOGETHER = 256
#: Words that a worker remembers; the newer half is full when a batch has filled it.
REMEMBERED = 800_000
_NULL = -(1 << 63)
#: a-z and the small letters of Latin-1, in UTF-8: no case to change, nothing to compose, no other pre-tokens.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_SPACE, _SMALL = byte_set(SPACES), byte_set(bytes(range(97, 123)))
_SMALL_LATIN = byte_set(bytes([*range(0x9F, 0xB7), *range(0xB8, 0xC0)]))
_APOSTROPHE = ord("'")
#: ASCII marks but the apostrophe, which may begin a contraction.
_MARK = byte_set(bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != _APOSTROPHE))
_HEAD = struct.Struct("<4sIIQQ")


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of the ids; the last group of eight is filled with zeros."""
    if bits in (8, 16, 32):  # whole bytes: the same layout as below
        whole = np.zeros(-(-len(ids) // 8) * 8, dtype=f"<u{bits // 8}")
        whole[:len(ids)] = ids
        return whole.view(np.uint8)
    groups = np.zeros((-(-len(ids) // 8), 8), dtype=np.uint64)
    groups.ravel()[:len(ids)] = ids
    out = np.zeros((len(groups), bits), dtype=np.uint8)
    for k in range(8):
        at, shift = divmod(k * bits, 8)
        value = groups[:, k] << np.uint64(shift)
        for byte in range(-(-(shift + bits) // 8)):
            out[:, at + byte] |= (value >> np.uint64(8 * byte)).astype(np.uint8)
    return out.ravel()


def unpack(data: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first n ids (uint32) of packed bytes."""
    data = data[:-(-n // 8) * bits]
    if bits in (8, 16, 32):
        return np.ascontiguousarray(data).view(f"<u{bits // 8}")[:n].astype(np.uint32)
    groups = data.reshape(-1, bits)
    out = np.empty((len(groups), 8), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for k in range(8):
        at, shift = divmod(k * bits, 8)
        value = np.zeros(len(groups), dtype=np.uint64)
        for byte in range(-(-(shift + bits) // 8)):
            value |= groups[:, at + byte].astype(np.uint64) << np.uint64(8 * byte)
        out[:, k] = (value >> np.uint64(shift)) & mask
    return out.ravel()[:n]


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def image(doc_ids: list[int | None], ids: list[bytes], bits: int, block: int = BLOCK) -> bytes:
    """A file image; ids are 32-bit integers in bytes, one entry for each document."""
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    if len(flat) and int(flat.max()) >> bits:
        raise ValueError(f"id {int(flat.max())} needs more than {bits} bits")
    first = np.cumsum([0, *map(len, ids)], dtype=np.uint64) // 4
    some = block * max(1, PACKED // block)  # full blocks leave no gap, so several are packed at a time
    packed = [pack(flat[lo:lo + some], bits) for lo in range(0, len(flat), some)]
    blocks = np.append(np.arange(0, len(flat), block) // 8 * bits, sum(map(len, packed)))
    names = np.array([_NULL if d is None else d for d in doc_ids], dtype="<i8")
    return b"".join((_HEAD.pack(MAGIC, bits, block, len(ids), len(flat)), names.tobytes(), first.astype("<u8").tobytes(),
                     blocks.astype("<u8").tobytes(), *(p.tobytes() for p in packed)))


class Image:
    """Random access to the documents of a file image (bytes, or a memory map)."""

    def __init__(self, data):
        self.data = np.frombuffer(data, dtype=np.uint8) if isinstance(data, bytes) else data
        magic, self.bits, self.block, docs, self.n = _HEAD.unpack(self.data[:_HEAD.size].tobytes())
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            at += 8 * count
            return np.frombuffer(self.data[at - 8 * count:at].tobytes(), dtype=kind)
        self.doc_ids, self.first = take("<i8", docs), take("<u8", docs + 1).astype(np.int64)
        self.blocks = take("<u8", -(-self.n // self.block) + 1).astype(np.int64)
        self.payload = at

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of the image; only the blocks that hold them are read."""
        if lo >= hi:
            return np.zeros(0, dtype=np.uint32)
        a, b = lo // self.block, -(-hi // self.block)
        data = self.data[self.payload + self.blocks[a]:self.payload + self.blocks[b]]
        return unpack(data, self.bits, min(self.n, b * self.block) - a * self.block)[lo - a * self.block:hi - a * self.block]

    def document(self, place: int) -> np.ndarray:
        return self.ids(int(self.first[place]), int(self.first[place + 1]))


def save(data: bytes, path: str) -> None:
    with open(path, "wb") as out:
        out.write(data)


def open_image(path: str) -> Image:
    return Image(np.memmap(path, dtype=np.uint8, mode="r"))


def pieces(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(number of each piece, distinct pieces, first piece of each text) of the texts in small letters.

    A piece is a word, cut before a mark (any of ASCII, apostrophe too) that
    follows a letter, and before a letter that follows a mark other than an
    apostrophe. Letters are those of ``_LETTERS``. No pre-token crosses such a
    place, and nothing composes over it.
    """
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
    inside = ~_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    latin = np.flatnonzero(data == 0xC3)  # the last byte is a line end, so all places have a next one
    latin = latin[_SMALL_LATIN[data[latin + 1]]]
    mark, starts, ends = _MARK[data], _SMALL[data], _SMALL[data]
    starts[latin] = ends[latin + 1] = True  # the first and last bytes of letters
    begin[1:] |= mark[:-1] & starts[1:]
    mark |= data == _APOSTROPHE
    begin[1:] |= ends[:-1] & mark[1:]
    place = np.flatnonzero(begin)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    first = np.searchsorted(place, np.concatenate(([0], np.cumsum(size))))
    letters = data[inside]
    offsets = np.append(np.flatnonzero(begin[inside]), len(letters)).astype(np.int32)
    made = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    return made.indices.to_numpy(), made.dictionary.to_pylist(), first


class WordEncoder:
    """Ids of whole texts by a tokenizer whose pre-tokens never cross white space.

    The library encodes each distinct piece of a word once; a worker remembers
    a bounded number of them. A-Z may be lower-cased first, as the tokenizer's
    normaliser does it too. Texts that may hold a special token's string go to
    the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.special = sorted({str(t.content).encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.remembered, self.new, self.old = REMEMBERED // 2, {}, {}
        # The same merges for words of plain letters, which the normaliser and the pattern leave whole.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix, entries = getattr(self.plain.model, "end_of_word_suffix", None), self.plain.get_vocab()
        self.ends = np.zeros(max(entries.values()) + 1, dtype=bool)
        self.ends[[v for k, v in entries.items() if suffix and k.endswith(suffix)]] = True

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words, many in one call: they are joined by blanks, and ids belong to the word in which they start."""
        out, groups = [], [words[i:i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        made = self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, made):
            begin = np.cumsum([0, *(len(w) + 1 for w in group[:-1])])
            starts = np.fromiter([a for a, _ in e.offsets], dtype=np.int64, count=len(e.offsets))
            ids, cut = np.array(e.ids, dtype="<u4").tobytes(), [*(4 * np.searchsorted(starts, begin)).tolist(), 4 * len(starts)]
            out.extend([ids[a:b] for a, b in zip(cut, cut[1:])])
        return out

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain letters: each ends with the only token that ends a word."""
        out, groups = [], [words[i:i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for group, e in zip(groups, self.plain.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            cut, flat = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), ids.tobytes()
            out.extend([flat[a:b] for a, b in zip([0, *cut], cut)] if len(cut) == len(group) else self._words(group))
        return out

    def _made(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words. All but long ones are remembered; of those, the ones not asked for lately go."""
        found = list(map(self.new.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        unknown = [words[i] for i in missing]
        again = list(map(self.old.get, unknown))
        need = [w for w, ids in zip(unknown, again) if ids is None]
        plain = [w for w in need if _LETTERS(w)]
        made = dict(zip(plain, self._letters([w.decode() for w in plain])))
        if len(plain) < len(need):
            other = [w for w in need if w not in made]
            made.update(zip(other, self._words([w.decode() for w in other])))
        if len(need) < len(unknown):
            made.update([(w, ids) for w, ids in zip(unknown, again) if ids is not None])
        for i, word in zip(missing, unknown):
            found[i] = made[word]
        self.new.update(made)
        for word in made:
            if len(word) > REMEMBERED_CHARS:
                del self.new[word]
        if len(self.new) >= self.remembered:
            self.old, self.new = self.new, {}
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as 32-bit integers in bytes."""
        whole = [i for i, text in enumerate(texts) if any(s in text for s in self.special)]
        apart = set(whole)
        number, words, first = pieces([b"" if i in apart else text for i, text in enumerate(texts)] if whole else texts)
        ids = self._made(words)
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        n = size[number]
        end = np.cumsum(n)
        # Each id's place among those of the distinct words.
        at = np.repeat((np.cumsum(size) - size)[number] - (end - n), n)
        at += np.arange(len(at))
        flat = np.frombuffer(b"".join(ids), dtype="<u4")[at].tobytes()
        cut = (4 * np.concatenate(([0], end))[first]).tolist()
        out = [flat[a:b] for a, b in zip(cut, cut[1:])]
        for i, made in zip(whole, self._library([texts[i].decode() for i in whole])):
            out[i] = made
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


IMAGES = "part int, local_start long, n_ids long, image binary"


def write(docs: DataFrame, encoder: Callable[[], WordEncoder], folder: str, end_id: int, image_ids: int = IMAGE_IDS) -> None:
    """Encode ``docs`` (doc_id, text) and store file images in doc_id order in ``folder``.

    ``encoder`` is called in the tasks. part is the number of the range of
    doc_id, local_start the ids of that range before the image.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, made = TaskContext.get().partitionId(), encoder()
        bits, end = bits_for(made.vocabulary), np.uint32(end_id).tobytes()
        names, ids, size, start = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()),
                                    pa.array([image(names, ids, bits)], pa.binary())], names=["part", "local_start", "n_ids", "image"])
        for batch in batches:
            for name, x in zip(batch.column("doc_id").to_pylist(), made.encode(texts_of(batch.column("text")))):
                names.append(name)
                ids.append(x + end)
                size += len(x) // 4 + 1
                if size >= image_ids:
                    yield flush()
                    start += size
                    names, ids, size = [], [], 0
        if names:
            yield flush()
        del names, ids
        release()
    key = F.xxhash64("text")
    ordered = (docs.select("doc_id", "text").repartitionByRange("doc_id", key).sortWithinPartitions("doc_id", key))
    ordered.mapInArrow(run, IMAGES).write.option("compression", "zstd").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids): each document's ids (32-bit little-endian in bytes) and the ids of all documents before it."""
    ready(spark)
    images = spark.read.schema(IMAGES).parquet(folder)
    sizes = images.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each range
    base = dict(zip([r.part for r in sizes], np.cumsum([0] + [r.n for r in sizes]).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, local, data in zip(*(batch.column(c).to_pylist() for c in ("part", "local_start", "image"))):
                made = Image(data)
                flat = made.ids(0, made.n).astype("<u4")
                ids = [flat[a:b].tobytes() for a, b in zip(made.first[:-1].tolist(), made.first[1:].tolist())]
                names = pa.array([None if d == _NULL else d for d in made.doc_ids.tolist()], pa.int64())
                yield pa.record_batch([names, pa.array(made.first[:-1] + base[part] + local, pa.int64()), pa.array(ids, pa.binary())],
                                      names=["doc_id", "start", "ids"])
    return images.select("part", "local_start", "image").mapInArrow(run, "doc_id long, start long, ids binary")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/packed-{uuid.uuid4().hex}"
