"""Table audit: presence, profile, range and duplicate checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normlens import spec as S
from normlens.functions.numeric import percent, round_even, rows_from_columns
from normlens.plans.relational import available_columns, with_row
from normlens.spec import DEFAULT_SPEC, NormSpec


def column_presence(df: DataFrame, spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """(alias, column, present, n_values) for every expected column."""
    counts = df.agg(*[
        (F.count(c) if c in df.columns else F.lit(0).cast("long")).alias(f"n_{alias}")
        for alias, c in spec.columns.items()
    ])
    return counts.select(rows_from_columns([
        F.struct(F.lit(alias).alias("alias"), F.lit(c).alias("column"),
                 F.lit(c in df.columns).alias("present"), F.col(f"n_{alias}").alias("n_values"))
        for alias, c in spec.columns.items()
    ]))


def _out_of_range(c: str, spec: NormSpec):
    lo, hi = spec.scale
    return F.count_if((F.col(c) < lo) | (F.col(c) > hi))


def column_profile(df: DataFrame, cols: list[str] | None = None,
                   spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """One row per column: type, missing share, and range, mean, SD of numbers.

    All columns are profiled by one aggregation over one scan.
    """
    cols = cols or df.columns
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(cols):
        aggs.append(F.count(c).alias(f"n{i}"))
        if c in numeric:
            v = F.col(c).cast("double")
            aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                     F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"sd{i}")]
        if c in S.RATING_COLUMNS:
            aggs.append(_out_of_range(c, spec).alias(f"out{i}"))
    types = dict(df.dtypes)

    def stat(c: str, i: int, tag: str):
        return round_even(f"{tag}{i}", 4) if c in numeric else F.lit(None).cast("double")

    wide = df.agg(*aggs)
    return wide.select(rows_from_columns([
        F.struct(
            F.lit(c).alias("Column"),
            F.lit(types[c]).alias("dtype"),
            (F.col("rows") - F.col(f"n{i}")).alias("N_missing"),
            percent(F.col("rows") - F.col(f"n{i}"), F.col("rows")).alias("Pct_missing"),
            stat(c, i, "lo").alias("min"),
            stat(c, i, "hi").alias("max"),
            stat(c, i, "mean").alias("mean"),
            stat(c, i, "sd").alias("SD"),
            (F.col(f"out{i}") if c in S.RATING_COLUMNS else F.lit(None).cast("long"))
            .alias("N_out_of_range_1_5"),
        )
        for i, c in enumerate(cols)
    ]))


def out_of_range_counts(df: DataFrame, spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """Values outside the rating scale per rating column."""
    cols = available_columns(df, S.RATING_COLUMNS)
    wide = df.agg(*[_out_of_range(c, spec).alias(c) for c in cols])
    return wide.select(rows_from_columns([
        F.struct(F.lit(c).alias("Column"), F.col(c).alias("n_out_of_range")) for c in cols
    ]))


def row_fingerprint(cols: list[str]) -> list[Column]:
    """Two 64-bit hashes of a row. NULLs are told apart by their places, which the hashes alone would skip."""
    gaps = F.concat(*[F.when(F.isnull(c), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return [F.xxhash64(F.lit(salt), gaps, *[F.col(c) for c in cols]).alias(name) for salt, name in ((1, "_f1"), (2, "_f2"))]


def duplicate_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows beyond the first of each group equal in ``cols``; NULL equals NULL.

    Fingerprints of 128 bits are counted first, so the shuffle of all rows
    carries 16 bytes of each. Only rows whose fingerprint occurs again are
    compared in full. Counting is combined on the map side in both steps, so a
    heavily repeated row or key reaches the shuffle as one record per task.
    """
    cols = cols or df.columns
    marked = df.select(*cols, *row_fingerprint(cols))
    again = marked.groupBy("_f1", "_f2").agg(F.count("*").alias("n")).where("n > 1").select("_f1", "_f2")
    return (
        marked.join(again, ["_f1", "_f2"], "left_semi").groupBy(*cols).agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("long")).alias("n_duplicates"))
    )


def duplicate_keys(df: DataFrame, spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """Duplicates of the word; NULL result when the table has no word column."""
    word = spec.columns["word"]
    if word not in df.columns:
        return df.agg(F.lit(None).cast("long").alias("n_duplicates"))
    return duplicate_rows(df, [word])


def dataset_summary(df: DataFrame, spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """Rating columns with table size, duplicates, missing share and observed range."""
    cols = available_columns(df, S.RATING_COLUMNS)
    lo, hi = spec.scale
    aggs = [F.count("*").alias("rows")]
    for c in cols:
        aggs += [F.count(c).alias(f"{c}_n"), F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi")]
    wide = with_row(with_row(df.agg(*aggs), duplicate_rows(df), "full"), duplicate_keys(df, spec), "keys")
    any_missing = F.greatest(*[F.col("rows") - F.col(f"{c}_n") for c in cols], F.lit(0)) > 0
    return wide.select(rows_from_columns([
        F.struct(
            F.lit(c).alias("Column"),
            F.col("rows").alias("n_rows"),
            F.lit(len(df.columns)).alias("n_columns"),
            F.col("full.n_duplicates").alias("duplicate_rows"),
            F.col("keys.n_duplicates").alias("duplicate_words"),
            (F.col("rows") - F.col(f"{c}_n")).alias("N_missing"),
            percent(F.col("rows") - F.col(f"{c}_n"), F.col("rows")).alias("Pct_missing"),
            any_missing.alias("any_missing"),
            round_even(f"{c}_lo", 2).alias("observed_min"),
            round_even(f"{c}_hi", 2).alias("observed_max"),
            ((F.col(f"{c}_lo") < lo) | (F.col(f"{c}_hi") > hi)).alias("out_of_range"),
        )
        for c in cols
    ]))
