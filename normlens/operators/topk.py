"""Top-n lists, exemplar categories and seeded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normlens import spec as S
from normlens.functions.hashing import key_text, seeded_digest
from normlens.functions.numeric import in_band
from normlens.operators.describe import is_bounded
from normlens.operators.ranking import Quantile, exact_quantiles
from normlens.plans.relational import available_columns, with_row
from normlens.spec import DEFAULT_SPEC, NormSpec

SHOWN = ("Word", "Valence", "PositiveAffect", "NegativeAffect")


def top_k(df: DataFrame, score: str, key: list[str], n: int | None = None,
          spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """The n rows with the highest score; ties go to the lower key."""
    keep = [*key, *available_columns(df, [*SHOWN, score])]
    return (
        df.select(*dict.fromkeys(keep))
        .where(F.col(score).isNotNull())
        .orderBy(F.col(score).desc(), *key)
        .limit(n or spec.top_rows)
    )


def exemplars(df: DataFrame, key: list[str], spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """Four illustrative categories; a row may appear in several.

    All four lists come from one scan: a task keeps the best rows of each
    category before the shuffle, so at most categories x rows x tasks records
    travel.
    """
    band = spec.primary_band
    score = "Ambivalence_product"
    inside = in_band("Valence", band.lo, band.hi)
    bounded = is_bounded(score, spec)
    limits = exact_quantiles(df, [
        Quantile("band_median", score, 0.5, where=inside, bounded=bounded),
        Quantile("pa_high", "PositiveAffect", 0.75),
        Quantile("na_low", "NegativeAffect", 0.25),
        Quantile("na_high", "NegativeAffect", 0.75),
        Quantile("val_low", "Valence", 0.25),
    ])
    shown = list(dict.fromkeys([*key, *SHOWN, score]))
    base = with_row(df.select(*shown), limits, "_at")
    at = {name: F.col(f"_at.{name}") for name in limits.columns}
    branches = (
        (inside & (F.col(score) <= at["band_median"]), score, False),
        (inside & (F.col(score) > at["band_median"]), score, True),
        ((F.col("PositiveAffect") >= at["pa_high"]) & (F.col("NegativeAffect") <= at["na_low"]),
         "PositiveAffect", True),
        ((F.col("Valence") <= at["val_low"]) & (F.col("NegativeAffect") >= at["na_high"]),
         "NegativeAffect", True),
    )
    # A row is sent once for each category that it is in, with the score by which the category ranks it.
    chosen = F.filter(F.array(*[
        F.when(rule, F.struct(F.lit(k).alias("place"), F.lit(label).alias("Category"),
                              (-F.col(by) if descending else F.col(by)).cast("double").alias("by")))
        for k, (label, (rule, by, descending)) in enumerate(zip(S.EXEMPLAR_CATEGORIES, branches))]), lambda c: c.isNotNull())
    order = Window.partitionBy("place").orderBy(F.col("by").asc_nulls_last(), *key)
    return (base.select(*shown, F.inline(chosen)).withColumn("_rank", F.row_number().over(order))
            .where(F.col("_rank") <= spec.exemplar_rows).select(*shown, "Category"))


def seeded_sample(df: DataFrame, key: list[str], n: int, drop_null: tuple[str, ...] = (),
                  band_col: str | None = None, sample_first: bool = False,
                  spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """A fixed-size uniform sample without replacement, optionally with a band flag.

    Rows are ordered by a seeded hash of their key and the first n are taken, in
    one scan: each task keeps its n smallest. ``sample_first`` takes the n rows
    before it drops those with missing values, so fewer may be left.
    """
    some = list(drop_null)
    rows = df.dropna(subset=some) if some and not sample_first else df
    picked = (rows.withColumn("_digest", seeded_digest(spec.seed, key_text(key)))
              .orderBy("_digest", *key).limit(n).drop("_digest"))
    if some and sample_first:
        picked = picked.dropna(subset=some)
    if band_col is None:
        return picked
    band = spec.primary_band
    return picked.withColumn("in_band", in_band(band_col, band.lo, band.hi))
