"""Histogram and kernel density tables behind the distribution figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlens import spec as S
from normlens.functions.numeric import as_col, round_even, rows_from_columns
from normlens.operators.ranking import distinct_counts, value_counts
from normlens.plans.relational import available_columns
from normlens.spec import DEFAULT_SPEC, NormSpec

# exp(-z*z/2) is exactly zero in double precision beyond this |z|.
KERNEL_REACH = 39.0
# Collapse repeated values before the density sum when they fit this bound.
COLLAPSE_LIMIT = 1 << 20


def _range_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """One small row per variable: n, mean, sd and range over its non-NULL values."""
    wide = df.agg(*[f(c).alias(f"{c}_{tag}") for c in cols for f, tag in (
        (F.count, "n"), (F.avg, "mean"), (F.stddev_samp, "sd"), (F.min, "lo"), (F.max, "hi"))])
    return wide.select(rows_from_columns([
        F.struct(F.lit(c).alias("variable"), F.col(f"{c}_n").alias("total"),
                 F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_sd").alias("sd"),
                 F.col(f"{c}_lo").cast("double").alias("lo"),
                 F.col(f"{c}_hi").cast("double").alias("hi"))
        for c in cols
    ]))


def _long_values(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(rows_from_columns([
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in cols
    ])).where(F.col("value").isNotNull())


def histogram(df: DataFrame, variables: Sequence[str] = S.STAT_VARIABLES, bins: int | None = None,
              spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """Equal-width density histogram: every bin of every variable, empty ones too.

    The last bin is closed on the right and a constant column gets a unit-wide
    range around its value. Rows fan out inside the scan stage and are counted
    there, so the shuffle carries at most variables x bins records per task.
    """
    bins = bins or spec.grid_bins
    cols = available_columns(df, list(variables))
    flat = F.col("hi") == F.col("lo")
    ranges = (
        _range_table(df, cols).where(F.col("total") > 0)
        .withColumns({"lo": F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")),
                      "hi": F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))})
        .withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    )

    def edge(i: Column) -> Column:
        return F.when(i >= bins, F.col("hi")).otherwise(F.col("lo") + i * F.col("width"))

    first = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins),
                    F.lit(bins - 1).cast("long"))
    settled = (
        F.when(F.col("value") < edge(F.col("guess")), F.col("guess") - 1)
        .when((F.col("value") >= edge(F.col("guess") + 1)) & (F.col("guess") < bins - 1),
              F.col("guess") + 1)
        .otherwise(F.col("guess"))
    )
    counted = (
        _long_values(df, cols)
        .join(F.broadcast(ranges), "variable")
        .withColumn("guess", first)
        .select("variable", settled.alias("bin"))
        .groupBy("variable", "bin").agg(F.count("*").alias("n"))
    )
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    band = spec.primary_band
    left, right = edge(F.col("bin")), edge(F.col("bin") + 1)
    return grid.join(counted, ["variable", "bin"], "left").select(
        F.col("variable").alias("Variable"),
        F.col("bin").alias("bin"),
        round_even(left, 6).alias("bin_left"),
        round_even(right, 6).alias("bin_right"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        round_even(F.coalesce("n", F.lit(0)) / (F.col("total") * F.col("width")), 6).alias("density"),
        ((F.col("variable") == spec.columns["valence"]) & (right >= band.lo) & (left <= band.hi))
        .alias("in_band"),
    )


def kde_curve(df: DataFrame, variables: Sequence[str] = S.SIDE_BY_SIDE_VARIABLES,
              spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """Gaussian kernel density on an even grid, Scott bandwidth; constants are skipped.

    A value contributes only to grid points within the kernel's floating-point
    reach, which is exact and shrinks with the bandwidth as the table grows.
    Contributions are summed inside the scan stage, so the shuffle carries at
    most variables x points records per task. Values are collapsed to counts
    first only when a check shows that this bounds them.
    """
    points = spec.kde_points
    cols = available_columns(df, list(variables))
    curves = (
        _range_table(df, cols)
        .where((F.col("total") > 1) & (F.col("sd") > 0) & (F.col("hi") > F.col("lo")))
        .withColumn("h", F.col("sd") * F.pow(F.col("total").cast("double"), F.lit(-0.2)))
        .withColumn("step", (F.col("hi") - F.col("lo")) / (points - 1))
    )
    sizes = distinct_counts(df, {c: as_col(c) for c in cols})
    if max(sizes.values()) <= COLLAPSE_LIMIT:
        weighted = value_counts(df, {c: as_col(c) for c in cols})
    else:
        weighted = _long_values(df, cols).withColumn("n", F.lit(1).cast("long"))
    reach = KERNEL_REACH * F.col("h")
    low = F.greatest(F.ceil((F.col("value") - reach - F.col("lo")) / F.col("step")), F.lit(0).cast("long"))
    high = F.least(F.floor((F.col("value") + reach - F.col("lo")) / F.col("step")),
                   F.lit(points - 1).cast("long"))
    z = (F.col("lo") + F.col("point") * F.col("step") - F.col("value")) / F.col("h")
    summed = (
        weighted.join(F.broadcast(curves), "variable")
        .withColumn("point", F.explode(F.sequence(low, high)))
        .groupBy("variable", "point")
        .agg(F.sum(F.col("n") * F.exp(-0.5 * z * z)).alias("kernel"))
    )
    grid = curves.withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    norm = F.col("total") * F.col("h") * 2.5066282746310002
    return grid.join(summed, ["variable", "point"], "left").select(
        F.col("variable").alias("Variable"),
        F.col("point"),
        round_even(F.col("lo") + F.col("point") * F.col("step"), 6).alias("x"),
        round_even(F.coalesce("kernel", F.lit(0.0)) / norm, 6).alias("density"),
    )


def kde_binned(df: DataFrame, variables: Sequence[str] = S.SIDE_BY_SIDE_VARIABLES, tolerance: float = 1e-6,
               spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """``kde_curve`` from linearly binned values, for columns of very many distinct values.

    A value is shared between the two nearest points of a fine grid, in
    proportion to its nearness; the kernel is then summed over fine points
    instead of values. The density is off by at most ``error_bound``, the error
    of linear interpolation of the kernel, width**2 / (8 sqrt(2 pi) h**3); the
    grid is as fine as keeps that at ``tolerance``. Its size follows the
    bandwidth (the 0.3rd power of the rows), not the number of values. The
    shuffle carries at most variables x fine points records for each task.
    """
    points = spec.kde_points
    cols = available_columns(df, list(variables))
    root = 2.5066282746310002
    curves = (
        _range_table(df, cols)
        .where((F.col("total") > 1) & (F.col("sd") > 0) & (F.col("hi") > F.col("lo")))
        .withColumn("h", F.col("sd") * F.pow(F.col("total").cast("double"), F.lit(-0.2)))
        .withColumn("step", (F.col("hi") - F.col("lo")) / (points - 1))
        .withColumn("cells", F.ceil((F.col("hi") - F.col("lo")) / F.sqrt(8.0 * root * tolerance * F.pow("h", F.lit(3.0)))))
        .withColumn("width", (F.col("hi") - F.col("lo")) / F.col("cells"))
    )
    place = (F.col("value") - F.col("lo")) / F.col("width")
    cell = F.least(F.floor(place), F.col("cells") - 1)
    share = F.col("place") - F.col("cell")
    binned = (
        _long_values(df, cols).join(F.broadcast(curves), "variable")
        .select("variable", place.alias("place"), cell.alias("cell"))
        .select("variable", F.inline(F.array(
            F.struct(F.col("cell").alias("fine"), (1.0 - share).alias("w")),
            F.struct((F.col("cell") + 1).alias("fine"), share.alias("w")))))
        .groupBy("variable", "fine").agg(F.sum("w").alias("w"))
    )
    at = F.col("fine") * F.col("width")
    reach = KERNEL_REACH * F.col("h")
    low = F.greatest(F.ceil((at - reach) / F.col("step")), F.lit(0).cast("long"))
    high = F.least(F.floor((at + reach) / F.col("step")), F.lit(points - 1).cast("long"))
    z = (F.col("point") * F.col("step") - at) / F.col("h")
    summed = (
        binned.join(F.broadcast(curves), "variable")
        .where(low <= high).withColumn("point", F.explode(F.sequence(low, high)))
        .groupBy("variable", "point").agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("kernel"))
    )
    grid = curves.withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    norm = F.col("total") * F.col("h") * root
    return grid.join(summed, ["variable", "point"], "left").select(
        F.col("variable").alias("Variable"), "point",
        round_even(F.col("lo") + F.col("point") * F.col("step"), 6).alias("x"),
        (F.coalesce("kernel", F.lit(0.0)) / norm).alias("density"),
        (F.col("width") * F.col("width") / (8.0 * root * F.pow("h", F.lit(3.0)))).alias("error_bound"),
    )
