"""Subgroup labels and their coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlens import spec as S
from normlens.functions.numeric import fixed_text, in_band, percent, pick, round_even, rows_from_columns
from normlens.operators.describe import is_bounded
from normlens.operators.ranking import Quantile, exact_quantiles
from normlens.plans.relational import with_row
from normlens.spec import DEFAULT_SPEC, NormSpec

SPLIT_VARIABLES = (("Frequency", "frequency"), ("Concreteness", "concreteness"),
                   ("Imageability", "imageability"))


def median_label(value: Column, cut: Column) -> Column:
    """High above the median, Low at or below it, NULL stays NULL."""
    return F.when(value > cut, "High").when(value <= cut, "Low")


def median_split(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """Rows with their High/Low label and the cut-off used."""
    cut = exact_quantiles(df, [Quantile("cutoff", col, 0.5)])
    return with_row(df.select(*keep, col), cut, "_c").select(
        *keep, col, median_label(F.col(col), F.col("_c.cutoff")).alias("subgroup"),
        F.col("_c.cutoff").alias("cutoff"))


def subgroup_coverage(df: DataFrame, spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """Size, share and reliability of every subgroup of six variables.

    One scan: each row yields one (variable, label) record per variable and
    these are counted before the shuffle. Absent columns give a SKIPPED row.
    """
    c = spec.columns
    score, valence = c["ambivalence_prod"], c["valence"]
    requests = [Quantile(f"cut_{alias}", c[alias], 0.5)
                for _, alias in SPLIT_VARIABLES if c[alias] in df.columns]
    if score in df.columns:
        requests.append(Quantile("cut_high", score, spec.high_quantile, bounded=is_bounded(score, spec)))
    cuts = exact_quantiles(df, requests) if requests else None
    source = with_row(df, cuts, "_cut") if cuts is not None else df
    labels: dict[str, Column] = {}
    cut_of: dict[str, Column] = {}
    note_of: dict[str, Column] = {}
    for variable, alias in SPLIT_VARIABLES:
        if c[alias] in df.columns:
            cut = F.col(f"_cut.cut_{alias}")
            labels[variable], cut_of[variable] = median_label(F.col(c[alias]), cut), cut
            note_of[variable] = F.concat(F.lit("Median split; cutoff = "), fixed_text(cut, 4))
    if c["pos"] in df.columns:
        labels[S.POS_VARIABLE] = F.coalesce(F.col(c["pos"]).cast("string"), F.lit("Unknown"))
        note_of[S.POS_VARIABLE] = F.lit("Nominal categories; no split applied")
    if valence in df.columns:
        band = spec.primary_band
        labels[S.NEAR_NEUTRAL_VARIABLE] = F.when(
            in_band(valence, band.lo, band.hi),
            F.lit(f"Near-neutral [{band.lo},{band.hi}]")).otherwise("Non-neutral")
        note_of[S.NEAR_NEUTRAL_VARIABLE] = F.lit(
            f"Near-neutral defined as Valence ∈ [{band.lo}, {band.hi}]")
    if score in df.columns:
        cut = F.col("_cut.cut_high")
        labels[score], cut_of[score] = F.when(
            F.coalesce(F.col(score) > cut, F.lit(False)),
            F.lit(f"High ambivalence (>{spec.high_quantile:.0%} quantile)"),
        ).otherwise("Low/moderate ambivalence"), cut
        note_of[score] = F.concat(F.lit(f"High = above Q{spec.high_quantile * 100:.0f} = "), fixed_text(cut, 4))
    long = source.select(rows_from_columns([
        F.struct(F.lit(v).alias("Variable"), label.alias("Subgroup")) for v, label in labels.items()]))
    counted = long.groupBy("Variable", "Subgroup").agg(F.count("*").alias("N"))
    # From here on there is one row per subgroup; cut-offs and notes join it now.
    # The totals are one short row, summed map-side, however many labels there are.
    totals = counted.agg(F.sum("N").alias("all"), *[
        F.coalesce(F.sum(F.when((F.col("Variable") == v) & F.col("Subgroup").isNull(), F.col("N"))), F.lit(0)).alias(f"missing_{i}")
        for i, v in enumerate(labels)])
    sized = with_row(counted.where(F.col("Subgroup").isNotNull()), totals, "_all").withColumns({
        "rows": (F.col("_all.all") / len(labels)).cast("long"),
        "missing": pick("Variable", {v: F.col(f"_all.missing_{i}") for i, v in enumerate(labels)}),
    })
    if cuts is not None:
        sized = with_row(sized, cuts, "_cut")
    table = sized.select(
        "Variable", "Subgroup", "N",
        percent(F.col("N"), F.col("rows")).alias("Pct_of_total"),
        round_even(pick("Variable", cut_of) if cut_of else F.lit(None).cast("double"), 4).alias("Cutoff"),
        pick("Variable", note_of).alias("Cutoff_note"),
        F.col("missing").alias("N_missing_in_var"),
        F.when(F.col("N") >= spec.min_group_rows, "YES")
        .otherwise(f"WARN: N<{spec.min_group_rows}").alias("Reliable"),
    )
    skipped = _skipped_rows(df, spec)
    return table if skipped is None else table.unionByName(skipped)


def _skipped_rows(df: DataFrame, spec: NormSpec) -> DataFrame | None:
    expected = (*SPLIT_VARIABLES, ("POS", "pos"), ("Near-neutral", "valence"),
                ("Ambivalence_product", "ambivalence_prod"))
    absent = [(v, spec.columns[a]) for v, a in expected if spec.columns[a] not in df.columns]
    if not absent:
        return None
    rows = df.agg(F.count("*").alias("rows"))
    return rows.select(F.col("rows"), rows_from_columns([
        F.struct(F.lit(v).alias("Variable"), F.lit(f"Column '{c}' not found").alias("Cutoff_note"))
        for v, c in absent
    ])).select(
        "Variable", F.lit("SKIPPED").alias("Subgroup"), F.lit(0).cast("long").alias("N"),
        F.lit(0.0).alias("Pct_of_total"), F.lit(None).cast("double").alias("Cutoff"), "Cutoff_note",
        F.col("rows").alias("N_missing_in_var"), F.lit(S.NOT_AVAILABLE).alias("Reliable"))


def small_subgroups(coverage: DataFrame, spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """Subgroups under the reliability size."""
    return coverage.where(F.col("Reliable").startswith("WARN")).select("Variable", "Subgroup", "N")
