"""Derived affect scores and the rescaling behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlens import spec as S
from normlens.functions.numeric import rescale, round_even, row_mean, rows_from_columns
from normlens.plans.relational import require_columns, with_row
from normlens.spec import DEFAULT_SPEC, NormSpec

PARAMS = "_scaling"


def add_affect_means(df: DataFrame, spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """PositiveAffect and NegativeAffect as NULL-skipping row means."""
    require_columns(df, spec.positive_sources, "PositiveAffect")
    require_columns(df, spec.negative_sources, "NegativeAffect")
    return df.withColumns({
        "PositiveAffect": row_mean(spec.positive_sources),
        "NegativeAffect": row_mean(spec.negative_sources),
    })


def _ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[f(c).alias(f"{c}_{tag}") for c in cols
                    for f, tag in ((F.min, "lo"), (F.max, "hi"))])


def _checked_rescale(col: str, to: tuple[float, float]) -> Column:
    lo, hi = F.col(f"{PARAMS}.{col}_lo"), F.col(f"{PARAMS}.{col}_hi")
    message = F.concat(F.lit(f"Cannot rescale {col}: zero range at "), lo.cast("string"))
    return F.when(hi == lo, F.raise_error(message).cast("double")).otherwise(rescale(col, lo, hi, to))


def minmax_scale(df: DataFrame, cols: list[str], suffix: str = "_01", strict: bool = True,
                 to: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Add a min-max scaled copy of each column, fitted on the whole frame.

    ``strict`` fails at run time on a zero range; otherwise the copy is NULL.
    """
    scaled = with_row(df, _ranges(df, cols), PARAMS)
    for c in cols:
        value = _checked_rescale(c, to) if strict else rescale(
            c, F.col(f"{PARAMS}.{c}_lo"), F.col(f"{PARAMS}.{c}_hi"), to)
        scaled = scaled.withColumn(c + suffix, value)
    return scaled.drop(PARAMS)


def add_targets(df: DataFrame, spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """The processed table: affect means, rescaled copies, both ambivalences, length.

    The product uses the unrounded scaled scores and propagates NULL; the
    minimum uses the rounded ones and skips NULL.
    """
    base = add_affect_means(df, spec)
    exact = minmax_scale(base, ["PositiveAffect", "NegativeAffect"], suffix="_exact",
                         to=spec.rescale_range)
    out = (
        exact
        .withColumn("PositiveAffect_01", round_even("PositiveAffect_exact", 6))
        .withColumn("NegativeAffect_01", round_even("NegativeAffect_exact", 6))
        .withColumn("Ambivalence_product",
                    round_even(F.col("PositiveAffect_exact") * F.col("NegativeAffect_exact"), 6))
        .withColumn("Ambivalence_min", F.least("PositiveAffect_01", "NegativeAffect_01"))
        .drop("PositiveAffect_exact", "NegativeAffect_exact")
    )
    return add_word_length(out, spec)


def add_word_length(df: DataFrame, spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """Character length, only when the table brings none; NULL words stay NULL."""
    length, word = spec.columns["length"], spec.columns["word"]
    if length in df.columns or word not in df.columns:
        return df
    return df.withColumn(length, F.length(word))


def rescale_params(df: DataFrame, cols: tuple[str, ...] = ("PositiveAffect", "NegativeAffect"),
                   note: str = S.RESCALE_NOTE) -> DataFrame:
    """One row per scaled column with the fitted minimum and maximum."""
    wide = _ranges(df, list(cols))
    return wide.select(rows_from_columns([
        F.struct(F.lit(c).alias("Column"), F.col(f"{c}_lo").alias("min"),
                 F.col(f"{c}_hi").alias("max"), F.lit(note).alias("note"))
        for c in cols
    ]))


def zscore(df: DataFrame, cols: list[str], suffix: str = "_z") -> DataFrame:
    """Standardise with the sample standard deviation; NULL for constant columns."""
    moments = df.agg(*[f(c).alias(f"{c}_{tag}") for c in cols
                       for f, tag in ((F.avg, "mean"), (F.stddev_samp, "sd"))])
    out = with_row(df, moments, PARAMS)
    for c in cols:
        out = out.withColumn(c + suffix, F.try_divide(
            F.col(c) - F.col(f"{PARAMS}.{c}_mean"), F.col(f"{PARAMS}.{c}_sd")))
    return out.drop(PARAMS)


def minmax_scale_by_fold(df: DataFrame, col: str, fold_col: str, folds: int) -> DataFrame:
    """Scale each held-out row with the range of the other folds only.

    One aggregation yields every fold's training range as an array, which the
    rows index by their own fold; no join is needed.
    """
    def others(fold: int) -> Column:
        return F.when(F.col(fold_col) != fold, F.col(col))

    ranges = df.agg(F.array(*[
        F.struct(F.min(others(f)).alias("lo"), F.max(others(f)).alias("hi"))
        for f in range(1, folds + 1)
    ]).alias("by_fold"))
    out = with_row(df, ranges, PARAMS)
    mine = F.element_at(F.col(f"{PARAMS}.by_fold"), F.col(fold_col))
    return (
        out
        .withColumn("train_min", mine["lo"])
        .withColumn("train_max", mine["hi"])
        .withColumn(f"{col}_01", rescale(col, mine["lo"], mine["hi"]))
        .drop(PARAMS)
    )
