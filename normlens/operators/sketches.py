"""Approximate quantiles from mergeable sketches, for when exact ones cost too much.

A sketch (KLL) of a column is a few kilobytes however many rows it stands for,
and sketches of parts of a table merge into that of the whole. So daily tables
can be sketched once and any range of days answered by merging. The rank of an
approximate quantile is off by at most ``rank_error(k)`` of the rows, with 99 %
confidence for each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.functions.numeric import rows_from_columns
from normlens.plans.relational import with_row

K = 1000


def rank_error(k: int = K) -> float:
    """Published bound of the sketch on the share of rows between the wanted and the returned rank."""
    return 2.296 / k**0.9021


def sketch_columns(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), k: int = K) -> DataFrame:
    """(*by, Variable, n, sketch): one mergeable sketch for each column and group; NULLs are left out."""
    wide = df.groupBy(*by).agg(*[e for c in cols for e in (
        F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(k)).alias(f"s_{c}"), F.count(c).alias(f"n_{c}"))])
    return wide.select(*by, rows_from_columns([
        F.struct(F.lit(c).alias("Variable"), F.col(f"n_{c}").alias("n"), F.col(f"s_{c}").alias("sketch")) for c in cols]))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, Variable, n, sketch) of all the parts of a group together."""
    return sketches.where("n > 0").groupBy(*by, "Variable").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles_of(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(all but the sketch, prob, value) of each sketch."""
    keep = [c for c in sketches.columns if c != "sketch"]
    points = F.array(*[F.lit(float(p)) for p in probs])
    both = F.arrays_zip(points.alias("prob"), F.kll_sketch_get_quantile_double("sketch", points).alias("value"))
    return sketches.where("n > 0").select(*keep, F.inline(both))


def approx_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], k: int = K) -> DataFrame:
    """Long table (Variable, prob, n, value), in one scan; a column without values has no rows."""
    return quantiles_of(sketch_columns(df, cols, k=k), probs).select("Variable", "prob", "n", "value")


def quantile_ranks(df: DataFrame, quantiles: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(Variable, prob, n, value, low, high): the exact share of values below, and at or below, each quantile.

    One scan; ``quantiles`` has a row for each column and probability and is read once.
    """
    at = quantiles.groupBy("Variable").agg(F.collect_list(F.struct("prob", "value", "n")).alias("q"))
    named = at.agg(F.map_from_entries(F.collect_list(F.struct("Variable", "q"))).alias("all"))
    long = with_row(df.select(*cols), named, "_q").select(rows_from_columns([
        F.struct(F.lit(c).alias("Variable"), F.col(c).cast("double").alias("x"), F.col("_q.all")[c].alias("q")) for c in cols]))
    return (
        long.where(F.col("x").isNotNull()).select("Variable", "x", F.inline("q"))
        .groupBy("Variable", "prob", "n", "value")
        .agg(F.avg((F.col("x") < F.col("value")).cast("int")).alias("low"),
             F.avg((F.col("x") <= F.col("value")).cast("int")).alias("high"))
    )


def quantile_check(df: DataFrame, cols: Sequence[str], probs: Sequence[float], k: int = K) -> DataFrame:
    """(Variable, prob, n, within): whether each approximate quantile's rank is within twice the stated error.

    A quantile of a value that many rows share has all the ranks of these rows.
    """
    ranked = quantile_ranks(df, approx_quantiles(df, cols, probs, k), cols)
    room = 2 * rank_error(k)
    return ranked.select("Variable", "prob", "n", (
        (F.col("low") - room <= F.col("prob")) & (F.col("prob") <= F.col("high") + room)).alias("within"))
