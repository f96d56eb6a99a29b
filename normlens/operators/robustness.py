"""How far the scores depend on formula, band, source set and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens import spec as S
from normlens.functions.numeric import pearson, round_even, row_mean, rows_from_columns
from normlens.operators.bands import band_sensitivity_inclusive
from normlens.operators.correlate import spearman_pair
from normlens.operators.describe import is_bounded
from normlens.operators.ranking import Quantile, exact_quantiles
from normlens.operators.targets import minmax_scale, zscore
from normlens.plans.relational import available_columns, materialize, skipped, with_row
from normlens.spec import DEFAULT_SPEC, NormSpec


def formula_comparison(df: DataFrame, a: str = "Ambivalence_product", b: str = "Ambivalence_min",
                       spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """Product against minimum: correlations, moments and upper-quartile agreement."""
    if a not in df.columns or b not in df.columns:
        return skipped(df, S.SKIPPED_FORMULA)
    both = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    limits = exact_quantiles(both, [
        Quantile(c, c, spec.high_quantile, bounded=is_bounded(c, spec)) for c in (a, b)])
    agree = ((F.col(a) >= F.col(f"_q.{a}")) == (F.col(b) >= F.col(f"_q.{b}"))).cast("int")
    stats = with_row(both, limits, "_q").agg(
        F.count("*").alias("n"),
        pearson(a, b).alias("r"),
        F.avg(a).alias("mean_a"), F.stddev_samp(a).alias("sd_a"),
        F.avg(b).alias("mean_b"), F.stddev_samp(b).alias("sd_b"),
        F.avg(agree).alias("agreement"),
    )
    ranked = with_row(stats, spearman_pair(both, a, b), "_s")
    return ranked.select(
        F.lit("Ambivalence formula comparison (product vs min)").alias("check"),
        F.col("n"),
        round_even("r", 4).alias("Pearson_r"),
        round_even("_s.r", 4).alias("Spearman_r"),
        round_even("mean_a", 4).alias("mean_product"),
        round_even("sd_a", 4).alias("SD_product"),
        round_even("mean_b", 4).alias("mean_min"),
        round_even("sd_b", 4).alias("SD_min"),
        round_even("agreement", 4).alias("top_Q3_agreement"),
        F.when(F.col("r") >= 0.90, S.VERDICT_SIMILAR).otherwise(S.VERDICT_DIVERGE).alias("conclusion"),
    )


def source_sensitivity(df: DataFrame, spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """NegativeAffect with and without the exploratory source, one scan for both."""
    extra = spec.exploratory_source
    sources = available_columns(df, list(spec.negative_sources))
    versions = []
    if "NegativeAffect" in df.columns and "PositiveAffect" in df.columns:
        versions.append(("PRIMARY", sources, F.col("NegativeAffect")))
    if extra in df.columns and sources:
        versions.append((f"EXPLORATORY ONLY - including {extra}", [*sources, extra],
                         row_mean([*sources, extra])))
    has_valence = "Valence" in df.columns
    aggs = []
    for k, (_, _, value) in enumerate(versions):
        r = pearson(value, "Valence") if has_valence else F.lit(None).cast("double")
        aggs += [F.avg(value).alias(f"m{k}"), r.alias(f"r{k}")]
    rows = [F.struct(F.lit(label).alias("Version"), F.lit(f"mean({', '.join(cols)})").alias("Formula"),
                     round_even(f"m{k}", 4).alias("mean_NegativeAffect"),
                     round_even(f"r{k}", 4).alias("corr_with_Valence"))
            for k, (label, cols, _) in enumerate(versions)]
    if extra not in df.columns:
        none = F.lit(None).cast("double")
        rows.append(F.struct(F.lit(f"EXPLORATORY {extra} inclusion").alias("Version"),
                             F.lit(S.NOT_AVAILABLE).alias("Formula"),
                             none.alias("mean_NegativeAffect"), none.alias("corr_with_Valence")))
    return df.agg(F.count("*").alias("rows"), *aggs).select(rows_from_columns(rows))


def scaling_sensitivity(df: DataFrame, spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """Correlation of the product score under min-max and under shifted z-scores."""
    cols = ["PositiveAffect", "NegativeAffect"]
    if len(available_columns(df, cols)) < len(cols):
        return skipped(df, S.SKIPPED_SCALING)
    plain = minmax_scale(df.select(*cols), cols, suffix="_mm", strict=False)
    shifted = minmax_scale(zscore(plain, cols), [f"{c}_z" for c in cols], suffix="_mm", strict=False)
    stats = shifted.agg(pearson(F.col("PositiveAffect_mm") * F.col("NegativeAffect_mm"),
                                F.col("PositiveAffect_z_mm") * F.col("NegativeAffect_z_mm")).alias("r"))
    return stats.select(
        F.lit("Scaling sensitivity").alias("check"),
        F.lit("Min-max to [0,1] (PRIMARY)").alias("Scaling_A"),
        F.lit("Z-score → shift to [0,1]").alias("Scaling_B"),
        round_even("r", 4).alias("Pearson_r_between"),
        F.when(F.col("r") >= 0.95, S.VERDICT_SCALING_ROBUST).otherwise(S.VERDICT_SCALING_EFFECT)
        .alias("conclusion"),
    )


def robustness_summary(df: DataFrame, spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """All checks stacked by column name; cells a check lacks read N/A.

    Each check is written out on its own, a few rows each: planning all of them
    as one union makes the plan far slower than its parts.
    """
    parts = [formula_comparison(df, spec=spec), band_sensitivity_inclusive(df, spec=spec),
             scaling_sensitivity(df, spec)]
    out = None
    for part in parts:
        text = materialize(part.select(*[F.col(c).cast("string").alias(c) for c in part.columns]))
        out = text if out is None else out.unionByName(text, allowMissingColumns=True)
    return out.na.fill(S.NOT_AVAILABLE)
