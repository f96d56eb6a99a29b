"""Near-neutral band summaries and their sensitivity to the band limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from normlens import spec as S
from normlens.functions.numeric import fixed_text, in_band, percent, round_even, rows_from_columns
from normlens.operators.describe import is_bounded
from normlens.operators.ranking import Quantile, exact_quantiles
from normlens.plans.relational import available_columns, skipped, with_row
from normlens.spec import DEFAULT_SPEC, Band, NormSpec

SCORES = ("Ambivalence_product", "Ambivalence_min")


def band_filter(df: DataFrame, band: Band, col: str = "Valence") -> DataFrame:
    """Rows inside the band; as a plain predicate it reaches the scan."""
    return df.where(F.col(col).between(band.lo, band.hi))


def high_thresholds(df: DataFrame, prob: float) -> DataFrame:
    """One row with the whole-table upper quantile of both ambivalence scores.

    The scores are 6-decimal values in [0, 1], so the number of distinct values
    is bounded no matter how many rows there are.
    """
    there = available_columns(df, SCORES)
    found = exact_quantiles(df, [Quantile(c, c, prob, bounded=is_bounded(c)) for c in there]) if there else df.agg(F.lit(1).alias("_one"))
    return found.select(*[F.col(c) if c in there else F.lit(None).cast("double").alias(c) for c in SCORES])


def band_stats(df: DataFrame, bands: Sequence[Band], inclusive: bool = False,
               spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """One row per band: size, mean scores and share above the upper quantile.

    Every band is a set of conditional aggregates over one scan, so overlapping
    bands cost no extra rows and empty bands stay in the result. Rows whose
    score is NULL count in the denominator of the share. Means and shares of
    columns that the table lacks are NULL; without valence each band has one
    row (position, threshold_label, error).
    """
    if "Valence" not in df.columns:
        return df.sparkSession.createDataFrame(
            [(i, band.label, "'Valence' column missing") for i, band in enumerate(bands)],
            "position int, threshold_label string, error string")
    absent = [c for c in S.DERIVED_TARGETS if c not in df.columns]
    source = with_row(df, high_thresholds(df, spec.high_quantile), "_high").withColumns(
        {c: F.lit(None).cast("double") for c in absent})
    aggs = [F.count("*").alias("rows"), *[F.any_value(f"_high.{c}").alias(f"q_{c}") for c in SCORES]]
    for i, band in enumerate(bands):
        inside = in_band("Valence", band.lo, band.hi)
        aggs.append(F.count_if(inside).alias(f"n{i}"))
        aggs += [F.avg(F.when(inside, F.col(c))).alias(f"m{i}_{c}") for c in S.DERIVED_TARGETS]
        for c in SCORES:
            limit = F.col(f"_high.{c}")
            above = F.col(c) >= limit if inclusive else F.col(c) > limit
            aggs.append(F.count_if(inside & above).alias(f"h{i}_{c}"))
    wide = source.agg(*aggs)
    return wide.select(rows_from_columns([
        F.struct(
            F.lit(i).alias("position"),
            F.lit(band.label).alias("threshold_label"),
            F.lit(band.text).alias("valence_range"),
            F.col(f"n{i}").alias("n_near_neutral"),
            percent(F.col(f"n{i}"), F.col("rows")).alias("pct_of_total"),
            *[round_even(f"m{i}_{c}", 4).alias(f"mean_{c}") for c in S.DERIVED_TARGETS],
            *[(F.lit(None).cast("double") if c in absent else percent(F.col(f"h{i}_{c}"), F.col(f"n{i}")))
              .alias(f"pct_high_{c.lower()}") for c in SCORES],
            round_even("q_Ambivalence_product", 4).alias("high_amb_product_threshold_Q3"),
            round_even("q_Ambivalence_min", 4).alias("high_amb_min_threshold_Q3"),
        )
        for i, band in enumerate(bands)
    ]))


def band_summary(df: DataFrame, band: Band | None = None, spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    return band_stats(df, [band or spec.primary_band], spec=spec).drop("position")


def _with_spread(stats: DataFrame) -> DataFrame:
    # The window runs over the handful of band rows, not over data.
    every = Window.partitionBy(F.lit(1))
    pct = F.col("pct_high_ambivalence_product")
    return stats.withColumn("spread", F.max(pct).over(every) - F.min(pct).over(every))


def band_sensitivity(df: DataFrame, bands: Sequence[Band] | None = None,
                     spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """Band summary for each band plus the verdict on the spread of the high share."""
    stats = band_stats(df, bands or spec.bands, spec=spec)
    if "Valence" not in df.columns:
        return stats.drop("position")
    stats = _with_spread(stats)
    verdict = F.when(F.col("spread") <= spec.spread_tolerance, S.VERDICT_BAND_ROBUST).when(
        F.col("spread") > spec.spread_tolerance, S.VERDICT_BAND_SENSITIVE)
    return (
        stats.withColumn("max_diff", round_even("spread", 2))
        .withColumn("verdict", verdict)
        .drop("position", "spread")
    )


def band_sensitivity_inclusive(df: DataFrame, bands: Sequence[Band] | None = None,
                               spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """The robustness variant: a score equal to the quantile counts as high."""
    if "Valence" not in df.columns:
        return skipped(df, S.SKIPPED_BANDS)
    stats = _with_spread(band_stats(df, bands or spec.bands, inclusive=True, spec=spec))
    lead = F.concat(F.lit("Max diff in %high-ambivalence across thresholds = "),
                    fixed_text("spread", 1), F.lit("% - "))
    verdict = F.when(F.col("spread") <= spec.spread_tolerance,
                     F.concat(lead, F.lit(f"{S.VERDICT_BAND_ROBUST} (≤{spec.spread_tolerance:g}%)."))
                     ).otherwise(
        F.concat(lead, F.lit(f"{S.VERDICT_BAND_SENSITIVE} (>{spec.spread_tolerance:g}%); discuss.")))
    return stats.select(
        F.lit("Near-neutral threshold sensitivity").alias("check"),
        F.col("threshold_label").alias("threshold"),
        F.col("valence_range").alias("range"),
        F.col("n_near_neutral").alias("N_near_neutral"),
        F.col("pct_of_total").alias("Pct_of_total"),
        F.col("pct_high_ambivalence_product").alias("Pct_high_ambivalence_Q3"),
        verdict.alias("sensitivity_conclusion"),
    )
