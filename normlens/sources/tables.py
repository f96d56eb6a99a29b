"""Reading and writing norm tables and reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normlens import spec as S

NORM_SCHEMA = T.StructType([
    T.StructField("Word", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in S.RATING_COLUMNS],
    *[T.StructField(c, T.DoubleType()) for c in ("Frequency_Zipf", "Concreteness", "Imageability", "AoA")],
    T.StructField("PoS", T.StringType()),
    T.StructField("Length", T.IntegerType()),
    *[T.StructField(c, T.DoubleType()) for c in ("DLP_RT", "DLP_Acc")],
])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing; downstream expressions rely on NULL."""
    floats = [f for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)) for f in floats}) if floats else df


def _existing(read: Callable[[], DataFrame], path: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Norms table not found: {path}") from error
        raise


def read_norms(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | None = NORM_SCHEMA, rename: Mapping[str, str] | None = None
               ) -> DataFrame:
    """The raw norms table with NaN turned into NULL.

    Columns of the file have the types that ``schema`` gives them; columns that
    it lacks in the file stay absent, others pass through. CSV needs a schema
    with its columns in order and reads no word as missing except an empty field.
    ``rename`` maps source column names to the expected ones.
    """
    if fmt == "csv":
        df = _existing(lambda: spark.read.schema(schema).csv(path, header=True, enforceSchema=False), path)
    else:
        df = _existing(lambda: spark.read.format(fmt).load(path), path)
        known = {f.name: f.dataType for f in schema} if schema is not None else {}
        df = df.withColumns({c: F.col(c).cast(known[c]) for c, kind in df.dtypes
                             if c in known and df.schema[c].dataType != known[c]})
    return nan_to_null(df.withColumnsRenamed(dict(rename or {})))


def write_processed(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(_existing(lambda: spark.read.parquet(path), path))


def write_report(table: DataFrame, path: str, order_by: Sequence[str] = ()) -> None:
    """A result table as one CSV file with a header, in the given order; for small tables only."""
    if order_by:
        table = table.orderBy(*[F.col(c).asc_nulls_last() for c in order_by])
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """True once a write to ``path`` has completed."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read ``path`` if it has been written before, otherwise build, write and read it.

    ``compute_or_reuse`` also minds settings and input files.
    """
    if not table_exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class _Folder:
    """Files of a folder on any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def read(self, name: str) -> str | None:
        if not self.files.exists(self._at(name)):
            return None
        stream = self.files.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file under another name and rename it, so that it is seen whole or not at all."""
        draft = self._at(f"_draft-{uuid.uuid4().hex}")
        stream = self.files.create(draft)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.files.delete(self._at(name), False)
        if not self.files.rename(draft, self._at(name)):
            raise OSError(f"could not publish {self.path}/{name}")

    def size_and_time(self, name: str) -> tuple[int, int]:
        status = self.files.getFileStatus(self.jvm.org.apache.hadoop.fs.Path(name))
        return status.getLen(), status.getModificationTime()


def input_snapshot(*inputs: DataFrame) -> str:
    """A digest of the files that the tables read: names, sizes and times of change."""
    lines = []
    for df in inputs:
        for name in sorted(df.inputFiles()):
            size, time = _Folder(df.sparkSession, name).size_and_time(name)
            lines.append(f"{name} {size} {time}")
    return sha256("\n".join(lines).encode()).hexdigest()


def compute_or_reuse(spark: SparkSession, path: str, build: Callable[[], DataFrame], settings: Mapping[str, object],
                     inputs: Sequence[DataFrame] = ()) -> DataFrame:
    """The table that ``build`` gives for these settings and input files, computed once.

    ``path`` holds a data folder for each build and a manifest for each digest of
    settings and input snapshot. The data are written to a new folder, counted,
    and only then does the manifest appear, by a rename. A build that was broken
    off has no manifest and is never read; one that other settings or changed
    files ask for does not replace it. A manifest whose table has lost rows is
    built again.
    """
    asked = json.dumps({"settings": dict(settings), "inputs": input_snapshot(*inputs)}, sort_keys=True, default=str)
    name, folder = f"manifest-{sha256(asked.encode()).hexdigest()}.json", _Folder(spark, path)
    known = folder.read(name)
    if known is not None:
        entry = json.loads(known)
        try:
            table = spark.read.parquet(f"{folder.path}/{entry['data']}")
            if table.count() == entry["rows"]:
                return table
        except AnalysisException:  # the data folder is gone
            pass
    data = f"data-{uuid.uuid4().hex}"
    build().write.parquet(f"{folder.path}/{data}")
    table = spark.read.parquet(f"{folder.path}/{data}")
    folder.publish(name, json.dumps({"asked": json.loads(asked), "data": data, "rows": table.count()}))
    return table
