"""Plan helpers shared by the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_row(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Attach a one-row frame to every row as the struct column ``name``.

    The row becomes an uncorrelated scalar subquery: it runs once, is shared by
    every reference, and reaches the tasks as a constant, so nothing is joined.
    """
    return df.withColumn(name, one_row.select(F.struct("*")).scalar())


def require_columns(df: DataFrame, wanted: list[str] | tuple[str, ...], purpose: str) -> None:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise KeyError(f"{purpose}: missing columns {missing}")


def available_columns(df: DataFrame, wanted: list[str] | tuple[str, ...]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def skipped(df: DataFrame, reason: tuple[str, str]) -> DataFrame:
    """One row (check, status) for a check whose columns the table lacks."""
    return df.sparkSession.createDataFrame([reason], "check string, status string")


def fits_rows(df: DataFrame, max_rows: int) -> bool:
    """True when the frame has at most ``max_rows`` rows; reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediates that the session names; a session on one machine may leave it unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="normlens-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate that several branches read, and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
