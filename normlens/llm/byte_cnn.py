"""Byte-level convolutions in numpy: one-hot bytes, several filter widths, ReLU, max pooling.

Texts are cut into windows of one length, each a row of bytes padded with
zeros. A filter of width w sums one learned weight for each of w neighbouring
bytes; its largest value over the window, if positive, is the feature.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Windows that are convolved at once; their values stay in cache.
GROUP = 32


def windows(texts: list[bytes], size: int, stride: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows of bytes, text of each row). Windows cover every byte; an empty text has one empty window.

    ``most`` keeps that many windows of a long text, evenly spread (for fitting only).
    """
    counts = np.array([max(1, -(-(len(t) - (size - stride)) // stride)) for t in texts], dtype=np.int64)
    chosen = [np.arange(n) if most is None or n <= most else np.linspace(0, n - 1, most).astype(np.int64) for n in counts]
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in chosen])
    out = np.zeros((len(owner), size), dtype=np.uint8)
    row = 0
    for text, places in zip(texts, chosen):
        data = np.frombuffer(text, dtype=np.uint8)
        for place in places.tolist():
            piece = data[place * stride:place * stride + size]
            out[row, :len(piece)] = piece
            row += 1
    return out, owner


class ByteConv:
    """Filters of several widths. ``tables[w]`` has shape (w, 256, filters)."""

    def __init__(self, widths: tuple[int, ...], filters: int, seed: int):
        rng = np.random.default_rng(seed)
        self.filters = filters
        self.tables = {w: rng.normal(0, 0.3 / np.sqrt(w), (w, 256, filters)).astype(np.float32) for w in widths}
        self.bias = np.zeros(len(widths) * filters, dtype=np.float32)

    @property
    def size(self) -> int:
        return len(self.bias)

    def pool(self, rows: np.ndarray, places: bool = False) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Features of every window, before the ReLU the best value plus the bias; with places, where it was."""
        across = np.ascontiguousarray(rows.T)
        best, at = [], {}
        for width, table in self.tables.items():
            n = len(across) - width + 1
            value = table[0][across[:n]]
            for j in range(1, width):
                value += table[j][across[j:j + n]]
            if places:
                at[width] = value.argmax(axis=0)
            best.append(value.max(axis=0))
        return np.concatenate(best, axis=1) + self.bias, at

    def compiled(self) -> "PairConv":
        return PairConv(self)

    def gradient(self, rows: np.ndarray, at: dict[int, np.ndarray], grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of the tables and the bias from those of the features (zero where the ReLU is shut)."""
        out, lo, cell = [], 0, np.arange(self.filters)
        for width, table in self.tables.items():
            part = grad[:, lo:lo + self.filters].ravel()
            lo += self.filters
            row = np.repeat(np.arange(len(rows)), self.filters)
            made = np.empty_like(table)
            for j in range(width):
                byte = rows[row, at[width].ravel() + j].astype(np.int64)
                where = byte * self.filters + np.tile(cell, len(rows))
                made[j] = np.bincount(where, part, 256 * self.filters).reshape(256, self.filters)
            out.append(made)
        return [*out, grad.sum(axis=0)]

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables.values(), self.bias]


class PairConv:
    """The same features with one look-up for two neighbouring bytes; made for use, not for fitting."""

    def __init__(self, conv: ByteConv):
        self.bias, self.steps = conv.bias, {}
        for width, table in conv.tables.items():
            pairs = [(j, (table[j][:, None] + table[j + 1][None]).reshape(1 << 16, -1)) for j in range(0, width - 1, 2)]
            self.steps[width] = pairs, (table[-1] if width % 2 else None)

    def pool(self, rows: np.ndarray) -> np.ndarray:
        out = []
        for lo in range(0, len(rows), GROUP):
            across = np.ascontiguousarray(rows[lo:lo + GROUP].T).astype(np.int32)
            pair = across[:-1] << 8 | across[1:]
            best = []
            for width, (pairs, last) in self.steps.items():
                n = len(across) - width + 1
                value = None
                for j, table in pairs:
                    part = table.take(pair[j:j + n], axis=0)
                    value = part if value is None else np.add(value, part, out=value)
                if last is not None:
                    part = last.take(across[width - 1:], axis=0)
                    value = part if value is None else np.add(value, part, out=value)
                best.append(value.max(axis=0))
            out.append(np.concatenate(best, axis=1))
        return np.concatenate(out) + self.bias


class Adam:
    def __init__(self, parameters: list[np.ndarray], rate: float):
        self.parameters, self.rate, self.step = parameters, rate, 0
        self.first = [np.zeros_like(p) for p in parameters]
        self.second = [np.zeros_like(p) for p in parameters]

    def update(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        for p, g, m, v in zip(self.parameters, gradients, self.first, self.second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> F.Column:
    """True for the fold that no model learns from; false for a null id, which has no remainder."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled_ids(labelled: DataFrame, most: int, doc_id: str = "doc_id") -> DataFrame:
    """At most ``most`` ids outside the held-out fold, by the order of their hash."""
    return (labelled.where(F.col(doc_id).isNotNull() & ~held_out(doc_id))
            .orderBy(F.xxhash64(F.lit(7), doc_id), doc_id).limit(most))


