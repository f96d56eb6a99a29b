"""Helpers that the text operators share: shipping code, Arrow batches, row keys."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlens.session import ship_package

#: Rows and bytes in one Arrow batch; a row of more bytes is a batch by itself.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Give workers this package and bound Arrow batches. Repeated calls do nothing more."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return pa.array(column.cast(pa.binary())).fill_null(b"").to_pylist()


def release() -> None:
    """Give freed memory back to the system, so that idle workers stay small beside the busy ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None],
                schema: str) -> DataFrame:
    """``mapInArrow`` with one output batch, or none, for each input batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if out is not None and out.num_rows:
                    yield out
                del out
        release()
    return df.mapInArrow(run, schema)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``docs`` has such a column already."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", names: tuple[str, str] = ("_k1", "_k2")) -> DataFrame:
    """Adds the join key of a row, two columns of these names: its id and the hash of its text.

    Rows that share a key share the text, so whatever follows from the text
    alone may be joined back by it, with null or repeated ids too. Callers that
    keep all columns of ``docs`` take names that are free.
    """
    return docs.withColumns({names[0]: F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), names[1]: F.xxhash64(text)})
