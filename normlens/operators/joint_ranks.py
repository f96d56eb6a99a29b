"""Average ranks of several columns, met again row by row, in two shuffles for any number of columns.

The table is stored once with a row id and counted by value buckets, whose
split points are quantiles of a sample of the rows. A value at two or more
split points fills buckets by itself: its rank follows from the counts, so a
row tells it by the bucket's number, all such columns in one record. Every
other non-NULL value becomes a record (column, id, value) and goes to a range
of buckets, where it is sorted and shifted by the counts of lower buckets. The
records of both kinds meet in chunks of neighbouring ids, where all ranks of a
row are together. NULLs travel in neither shuffle, and no value that many rows
hold goes to one place.

A column that a partner's NULLs thin out has further ranks: ``present`` bits
tell each record which of the NULL-bearing columns its row has, and one sort
gives the rank among all rows and among the rows of each bit.

The split points steer the load only; any give the same exact ranks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.plans.relational import materialize
from normlens.session import ship_package

CHUNK_BITS = 12
BUCKETS = 1 << 12
SAMPLE_PER_BUCKET = 16
#: Records that are sorted together, about.
ROWS_PER_RANGE = 1 << 20
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


@dataclass(frozen=True)
class Buckets:
    """Split points of each column (columns, buckets - 1), ascending."""

    splits: np.ndarray

    @property
    def count(self) -> int:
        return self.splits.shape[1] + 1

    def place(self, column: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each value, and whether the bucket is that value's own.

        A bucket holds what is above the split before it up to its own split. A
        repeated split has its own bucket behind its first one.
        """
        first = np.searchsorted(self.splits[column], values, side="left")
        own = np.searchsorted(self.splits[column], values, side="right") - first > 1
        return first + own, own


def _columns(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """The columns v0.. as float64, NaN for NULL."""
    return [batch.column(f"v{i}").to_numpy(zero_copy_only=False).astype("float64", copy=False) for i in range(size)]


def _bits(values: list[np.ndarray], holed: Sequence[int]) -> np.ndarray:
    """Bit 0 always, bit k + 1 where the k-th NULL-bearing column has a value."""
    bits = np.ones(len(values[0]), dtype=np.int64)
    for k, i in enumerate(holed):
        bits |= (~np.isnan(values[i])).astype(np.int64) << (k + 1)
    return bits


def _splits(base: DataFrame, size: int, rows: int, buckets: int) -> Buckets:
    every = max(1, rows // (SAMPLE_PER_BUCKET * buckets))
    # About SAMPLE_PER_BUCKET rows for each bucket.
    sample = base.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).drop("id").toPandas().to_numpy(dtype="float64")
    splits = np.zeros((size, buckets - 1))
    for i in range(size):
        known = np.sort(sample[:, i][~np.isnan(sample[:, i])])
        if len(known):
            splits[i] = known[np.arange(1, buckets) * len(known) // buckets]
    return Buckets(splits)


def _bucket_counts(base: DataFrame, buckets: Buckets, holed: Sequence[int]) -> np.ndarray:
    """Records of each column, bucket and bit: (columns, buckets, bits)."""
    shape = (len(buckets.splits), buckets.count, len(holed) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=np.int64)
        for batch in batches:
            values = _columns(batch, shape[0])
            bits = _bits(values, holed)
            for i, v in enumerate(values):
                known = ~np.isnan(v)
                at = buckets.place(i, v[known])[0]
                for m in range(shape[2]):
                    total[i, :, m] += np.bincount(at[bits[known] >> m & 1 == 1], minlength=shape[1])
        cell = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cell), pa.array(total.ravel()[cell])], names=["cell", "n"])
    out = np.zeros(shape, dtype=np.int64)
    # At most columns x buckets x bits rows.
    for row in base.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out.ravel()[row.cell] = row.n
    return out


def rank_sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(pair, n, sx, sy, sxx, syy, sxy) of the ranks of each pair (i, j), i <= j, in order.

    Ranks are taken over the pair's complete rows, ties share their mean; sums
    are of ranks less their centre.
    """
    ship_package(df.sparkSession)
    size = len(cols)
    base = materialize(df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if base.rdd.getNumPartitions() < cores:  # a table of few files; it is read three times below
        base = base.repartition(cores)
    base = materialize(base.withColumn("id", F.monotonically_increasing_id()))
    known = base.agg(F.count("*"), *[F.count(f"v{i}") for i in range(size)]).first()
    holed = [i for i in range(size) if known[i + 1] < known[0]]
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = 1 << max(2, (max(2 * partitions, known[0] // ROWS_PER_RANGE) - 1).bit_length())
    buckets = _splits(base, size, known[0], max(BUCKETS, ranges))
    counts = _bucket_counts(base, buckets, holed)
    below = np.cumsum(counts, axis=1) - counts
    totals = counts.sum(axis=1)
    span, bits = buckets.count // ranges, len(holed) + 1
    names = ["id", "column", "codes", *[f"r{m}" for m in range(bits)]]
    schema = "id long, column int, codes array<int>, " + ", ".join(f"r{m} double" for m in range(bits))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One record for each row: of every column the bucket if it is its value's own, else -1."""
        for batch in batches:
            values = _columns(batch, size)
            codes = np.full((batch.num_rows, size), -1, dtype=np.int32)
            for i, v in enumerate(values):
                rows = np.flatnonzero(~np.isnan(v))
                at, own = buckets.place(i, v[rows])
                codes[rows[own], i] = at[own]
            lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, size, dtype=np.int32), codes.ravel())
            yield pa.record_batch([batch.column("id"), pa.array(np.full(len(codes), -1, dtype=np.int32)), lists,
                                   *[pa.nulls(len(codes), pa.float64())] * bits], names=names)

    def melt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One record for each value that shares its bucket with others."""
        for batch in batches:
            values, ids = _columns(batch, size), batch.column("id").to_numpy()
            present = _bits(values, holed)
            for i, v in enumerate(values):
                rows = np.flatnonzero(~np.isnan(v))
                at, own = buckets.place(i, v[rows])
                rows, at = rows[~own], at[~own]
                if len(rows):
                    yield pa.record_batch([pa.array(i * ranges + at // span, pa.int64()), pa.array(ids[rows]), pa.array(v[rows]),
                                           pa.array(present[rows])], names=["part", "id", "value", "present"])

    def rank(table: pa.Table) -> pa.Table:
        column = table.column("part")[0].as_py() // ranges
        value, present = table.column("value").to_numpy(), table.column("present").to_numpy()
        order = np.argsort(value, kind="stable")
        value, present = value[order], present[order]
        bucket = buckets.place(column, value)[0]
        new = np.concatenate(([True], value[1:] != value[:-1]))
        begin = np.flatnonzero(new)
        end, group = np.append(begin[1:], len(value)), np.cumsum(new) - 1
        home = bucket[begin]
        start = np.searchsorted(bucket, home)
        made = np.empty((bits, len(value)))
        for m in range(bits):
            upto = np.concatenate(([0], np.cumsum(present >> m & 1)))
            # Ties share the mean of their places.
            mean = below[column, home, m] + (upto[begin] + upto[end] + 1) / 2 - upto[start]
            made[m, order] = mean[group]
        size = len(value)
        return pa.table([table.column("id"), pa.array(np.full(size, column, dtype=np.int32)), pa.nulls(size, pa.list_(pa.int32())),
                         *map(pa.array, made)], names=names)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    #: Bit of the ranks that column i has beside column j.
    bit_for = {(i, j): holed.index(j) + 1 if j in holed and i != j else 0 for i in range(size) for j in range(size)}
    centre = (totals + 1) / 2

    own_rank = below + (counts + 1) / 2 - centre[:, None]

    def sums(table: pa.Table) -> pa.Table:
        place = table.column("id").to_numpy() & (1 << CHUNK_BITS) - 1
        column = table.column("column").to_numpy()
        ranks = np.full((bits, size, 1 << CHUNK_BITS), np.nan)
        single, told = np.flatnonzero(column >= 0), np.flatnonzero(column < 0)
        for m in range(bits):
            ranks[m, column[single], place[single]] = table.column(f"r{m}").to_numpy()[single] - centre[column[single], m]
        codes = table.column("codes").combine_chunks().flatten().to_numpy().reshape(-1, size)
        for i in range(size):
            some = np.flatnonzero(codes[:, i] >= 0)
            ranks[:, i, place[told[some]]] = own_rank[i, codes[some, i]].T
        out = np.zeros((len(pairs), len(SUMS)))
        for k, (i, j) in enumerate(pairs):
            x, y = ranks[bit_for[i, j], i], ranks[bit_for[j, i], j]
            both = ~(np.isnan(x) | np.isnan(y))
            x, y = x[both], y[both]
            out[k] = (len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y)
        return pa.table([pa.array(np.arange(len(pairs), dtype=np.int32)), *map(pa.array, out.T)], names=["pair", *SUMS])

    ranked = base.mapInArrow(melt, "part long, id long, value double, present long").groupBy("part").applyInArrow(rank, schema)
    return (base.mapInArrow(tell, schema).unionByName(ranked).groupBy(F.shiftright("id", CHUNK_BITS).alias("chunk"))
            .applyInArrow(sums, "pair int, " + ", ".join(f"{c} double" for c in SUMS))
            .groupBy("pair").agg(*[F.sum(c).alias(c) for c in SUMS]))
