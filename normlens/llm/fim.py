"""Fill-in-middle transformation: documents cut in three parts, the middle moved to the end.

A text of n units is cut at two places drawn from its id, and written as

    psm    <P> prefix <S> suffix <M> middle
    spm    <S> suffix <P> prefix <M> middle
    plain  the text itself

Units are code points, or lines (a line ends with its ``\\n``; what follows the
last one is a line too). The draws are the first four groups of eight digits
of the SHA-256 of ``seed:id``, so they need no state and any task repeats them.

Cuts are found by words of eight bytes. The texts of a block are laid out as
little-endian uint64, each text padded with zeros to whole words. Arithmetic
within the words marks the last byte of every unit (for code points: a byte
whose successor is not 10xxxxxx); ``bitwise_count`` gives the units of each
word and their running sum finds the word of a cut by binary search. Within
the word, a multiplication adds up the marks of the lower bytes, and the bytes
still below the wanted count are counted. No text is decoded.

A text is plain if it is empty, holds one of the three markers, or by its
draw. So the markers of an output are its own, each once, and ``restore``
finds the parts again.

Edge cases: null text is the empty text, and its output is empty; a null id
draws as the text ``seed:``; texts of any length are cut whole, one longer than
a block being a block by itself; repeated rows give repeated rows; an empty
table gives an empty table. Columns of ``docs`` named as the new ones are
replaced.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from normlens.llm.frames import map_batches, ready, texts_of
from normlens.llm.words import blocks

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
UNITS = ("char", "line")
#: Of 100 documents so many stay plain, and so many of the others are spm.
PLAIN_PERCENT, SPM_PERCENT = 10, 20

_HIGH = np.uint64(0x8080808080808080)
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_ONES = np.uint64(0x0101010101010101)
_NEWLINES = np.uint64(0x0A0A0A0A0A0A0A0A)


def mark_ends(words: np.ndarray, last_word: np.ndarray, rest: np.ndarray, unit: str) -> np.ndarray:
    """Bit 7 of every byte that ends a unit.

    ``last_word`` are the words that hold the last byte of a text, ``rest`` the
    bytes of the text in them (1 to 8).
    """
    if unit == "char":
        going_on = words & ~(words << np.uint64(1)) & _HIGH  # 10xxxxxx
        begins = going_on ^ _HIGH
        ends = begins >> np.uint64(8)
        ends[:-1] |= begins[1:] << np.uint64(56)
    else:
        other = words ^ _NEWLINES
        ends = ~(((other & _LOW) + _LOW) | other) & _HIGH  # bytes that are zero now
    final = np.uint64(0x80) << ((rest - 1).astype(np.uint64) << np.uint64(3))
    below = final | (final - np.uint64(1))
    ends[last_word] = ends[last_word] & below | final
    return ends


def select_in_word(ends: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place (0 to 7) of the byte with the ``rank``-th mark (from 1) of each word."""
    upto = (ends >> np.uint64(7)) * _ONES  # each byte: the marks in it and in the lower ones
    reached = ((upto | _HIGH) - rank.astype(np.uint64) * _ONES) & _HIGH
    return 8 - np.bitwise_count(reached).astype(np.int64)


class UnitIndex:
    """Units of the texts of a block."""

    def __init__(self, texts: list[bytes], unit: str = "char"):
        if unit not in UNITS:
            raise ValueError(f"unit must be one of {UNITS}")
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        wide = -(-sizes // 8)
        self.first = np.concatenate(([0], np.cumsum(wide)))
        self.words = np.frombuffer(b"".join([t.ljust(w * 8, b"\0") for t, w in zip(texts, wide.tolist())]), dtype="<u8")
        self.ends = self.words
        if len(self.words):
            some = sizes > 0
            self.ends = mark_ends(self.words, self.first[1:][some] - 1, (sizes - 8 * (wide - 1))[some], unit)
        self.upto = np.concatenate(([0], np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)))
        self.n = self.upto[self.first[1:]] - self.upto[self.first[:-1]]

    def offsets(self, units: np.ndarray) -> np.ndarray:
        """Bytes of the first ``units`` units of each text (0 to n)."""
        out = np.zeros(len(units), dtype=np.int64)
        some = np.flatnonzero(units > 0)
        if len(some):
            wanted = self.upto[self.first[some]] + units[some]
            word = np.searchsorted(self.upto, wanted) - 1
            out[some] = (word - self.first[some]) * 8 + select_in_word(self.ends[word], wanted - self.upto[word]) + 1
        return out


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    digits = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(digits[:8], 16), int(digits[8:16], 16), int(digits[16:24], 16), int(digits[24:32], 16)


def cut(texts: list[bytes], doc_ids: list[int | None], seed: int = 1, unit: str = "char",
        plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT
        ) -> tuple[list[bytes], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Output and form of each text, its units, and those of its prefix and its middle."""
    index = UnitIndex(texts, unit)
    h = np.array([draws(seed, d) for d in doc_ids], dtype=np.int64).reshape(-1, 4)
    a, b = h[:, 0] % (index.n + 1), h[:, 1] % (index.n + 1)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    plain = (h[:, 2] % 100 >= 100 - plain_percent).tolist()
    spm = (h[:, 3] % 100 < spm_percent).tolist()
    outputs, forms = [], []
    for text, p, q, keep, swap in zip(texts, index.offsets(lo).tolist(), index.offsets(hi).tolist(), plain, spm):
        if keep or not text or any(m in text for m in MARKERS):
            outputs.append(text)
            forms.append("plain")
        elif swap:
            outputs.append(b"".join((SUFFIX, text[q:], PREFIX, text[:p], MIDDLE, text[p:q])))
            forms.append("spm")
        else:
            outputs.append(b"".join((PREFIX, text[:p], SUFFIX, text[q:], MIDDLE, text[p:q])))
            forms.append("psm")
    return outputs, forms, index.n, lo, hi - lo


def rebuild(output: bytes, form: str) -> bytes:
    """The text of an output."""
    if form == "plain":
        return output
    head, _, middle = output.partition(MIDDLE)
    if form == "psm":
        prefix, _, suffix = head[len(PREFIX):].partition(SUFFIX)
    else:
        suffix, _, prefix = head[len(SUFFIX):].partition(PREFIX)
    return b"".join((prefix, middle, suffix))


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", out: str = "fim", seed: int = 1,
              unit: str = "char", plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """All columns of ``docs`` and ``out`` (the output text), ``form``, ``n_units``,
    ``prefix_units`` and ``middle_units`` (null if plain)."""
    ready(docs.sparkSession)
    made = (out, "form", "n_units", "prefix_units", "middle_units")
    kept = docs.drop(*[c for c in made if c not in (text, doc_id)])
    if {text, doc_id} & set(made):
        raise ValueError(f"text and id columns must not be named as one of {made}")
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.StringType()), T.StructField("form", T.StringType()),
                           *[T.StructField(c, T.LongType()) for c in made[2:]]])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, ids = texts_of(batch.column(text)), batch.column(doc_id).to_pylist()
        parts = [cut(texts[lo:hi], ids[lo:hi], seed, unit, plain_percent, spm_percent) for lo, hi in blocks(texts)]
        outputs = [o for p in parts for o in p[0]]
        forms = pa.array([f for p in parts for f in p[1]], pa.string())
        n, prefix, middle = (np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
        plain = np.array([f == "plain" for p in parts for f in p[1]])
        columns = [pa.array(outputs, pa.binary()).cast(pa.string()), forms, pa.array(n),
                   pa.array(prefix, mask=plain), pa.array(middle, mask=plain)]
        return pa.record_batch([*batch.columns, *columns], names=schema.names)
    return map_batches(kept, run, schema)


def restore(rows: DataFrame, out: str = "fim", form: str = "form", text: str = "restored") -> DataFrame:
    """All columns of ``rows`` and ``text``, rebuilt from outputs and forms."""
    ready(rows.sparkSession)
    kept = rows.drop(text)
    schema = T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = map(rebuild, texts_of(batch.column(out)), batch.column(form).to_pylist())
        return pa.record_batch([*batch.columns, pa.array(list(made), pa.binary()).cast(pa.string())], names=schema.names)
    return map_batches(kept, run, schema)
