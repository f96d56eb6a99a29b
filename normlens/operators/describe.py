"""Descriptive statistics tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens import spec as S
from normlens.functions.numeric import pick, round_even, rows_from_columns
from normlens.operators.ranking import Quantile, exact_quantiles
from normlens.plans.relational import available_columns, with_row
from normlens.spec import NormSpec

# Scores that are 6-decimal values in [0, 1] by construction.
BOUNDED_SCORES = ("Ambivalence_product", "Ambivalence_min", "PositiveAffect_01", "NegativeAffect_01")


def is_bounded(column: str, spec: NormSpec = S.DEFAULT_SPEC) -> bool:
    """True if the settings leave the score at most 1,000,001 different values."""
    return column in BOUNDED_SCORES and spec.rescale_range == (0.0, 1.0)


QUARTILES = (("q1", 0.25), ("median", 0.5), ("q3", 0.75))


def _moments_and_quartiles(df: DataFrame, cols: list[str], shape: bool) -> DataFrame:
    """One row per variable: moments, range and quartiles of its non-NULL values.

    Values are laid out long inside the scan stage; grouping by variable keeps
    the generated aggregation small and shuffles one record per variable a task.
    """
    long = df.select(rows_from_columns([
        F.struct(F.lit(c).alias("Variable"), F.col(c).cast("double").alias("v")) for c in cols]))
    aggs = [F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"),
            F.min("v").alias("lo"), F.max("v").alias("hi")]
    if shape:
        aggs += [F.skewness("v").alias("skew"), F.kurtosis("v").alias("kurt")]
    quartiles = exact_quantiles(df, [
        Quantile(f"{c}_{tag}", c, p, bounded=is_bounded(c)) for c in cols for tag, p in QUARTILES])
    picked = [
        pick("Variable", {c: F.col(f"_q.{c}_{tag}") for c in cols}).alias(tag)
        for tag, _ in QUARTILES
    ]
    return with_row(long.groupBy("Variable").agg(*aggs), quartiles, "_q").select("*", *picked).drop("_q")


def descriptives(df: DataFrame, variables: Sequence[str] = S.STAT_VARIABLES) -> DataFrame:
    """N, mean, SD, range, quartiles, IQR, skewness and excess kurtosis per variable.

    Variables the table lacks are skipped. Skewness and kurtosis are the biased
    (population) forms.
    """
    cols = available_columns(df, list(variables))
    return _moments_and_quartiles(df, cols, shape=True).select(
        "Variable",
        F.col("n").alias("N"),
        *[round_even(value, 4).alias(name) for name, value in (
            ("Mean", F.col("mean")), ("SD", F.col("sd")), ("Min", F.col("lo")), ("Max", F.col("hi")),
            ("Median", F.col("median")), ("Q1", F.col("q1")), ("Q3", F.col("q3")),
            ("IQR", F.col("q3") - F.col("q1")), ("Skewness", F.col("skew")), ("Kurtosis", F.col("kurt")))],
    )


def describe(df: DataFrame, variables: Sequence[str] = S.DERIVED_TARGETS) -> DataFrame:
    """count, mean, std, min, quartiles and max, with exact quartiles."""
    cols = available_columns(df, list(variables))
    return _moments_and_quartiles(df, cols, shape=False).select(
        "Variable",
        F.col("n").alias("count"),
        *[round_even(tag, 4).alias(name) for name, tag in (
            ("mean", "mean"), ("std", "sd"), ("min", "lo"), ("25%", "q1"),
            ("50%", "median"), ("75%", "q3"), ("max", "hi"))],
    )
