"""Exact ranks and quantiles that never gather one column in one task.

Values are first collapsed to (variable, value, count) with map-side combining,
so a value that fills a third of the table is still one record per task. What
follows depends on the number of distinct values, which is checked first:

* up to ``DISTINCT_LIMIT`` the collapsed column goes to ``percentile``;
* beyond it the values are cut into buckets, each bucket is sorted on its own
  and shifted by the number of rows in lower buckets.

Split points come from a hash-chosen sample of the values, so they are the same
in every evaluation, and they steer only the load: any split gives the same
exact ranks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlens.functions.numeric import pick, rows_from_columns
from normlens.plans.relational import with_row

# Collapsed columns of at most this many values are handled by one task. Scores
# rounded to 6 decimals in [0, 1] have 1,000,001 values and stay below it.
DISTINCT_LIMIT = 1 << 20
SAMPLE_PER_BUCKET = 64


@dataclass(frozen=True)
class Quantile:
    """A requested quantile; ``where`` restricts it to a subset of the rows.

    ``bounded`` marks columns whose number of distinct values is limited by
    construction, which saves the check.
    """

    name: str
    column: str
    prob: float
    where: Column | None = None
    bounded: bool = False


def distinct_counts(df: DataFrame, values: dict[str, Column]) -> dict[str, int]:
    """Approximate distinct counts: one pass, one small row to the driver."""
    if not values:
        return {}
    row = df.agg(*[F.approx_count_distinct(v).alias(f"d{i}")
                   for i, v in enumerate(values.values())]).first()
    return dict(zip(values, row))


def bucket_count(df: DataFrame) -> int:
    """Buckets per variable: a power of two around four per shuffle partition."""
    target = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(4, min(12, target.bit_length() - 1))


def value_counts(df: DataFrame, values: dict[str, Column],
                 masks: dict[str, Column] | None = None) -> DataFrame:
    """(variable, value, n) for several columns in one scan; NULLs are left out.

    Each mask adds ``n_<mask>``, the count over the rows where it holds.
    """
    masks = masks or {}
    wide = df.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values())],
                     *[c.alias(f"mask_{m}") for m, c in masks.items()])
    flags = [F.col(f"mask_{m}") for m in masks]
    structs = [F.struct(F.lit(name).alias("variable"), F.col(f"v{i}").alias("value"))
               for i, name in enumerate(values)]
    return (
        wide.select(*flags, rows_from_columns(structs))
        .where(F.col("value").isNotNull())
        .groupBy("variable", "value")
        .agg(F.count("*").alias("n"),
             *[F.count_if(f"mask_{m}").alias(f"n_{m}") for m in masks])
    )


def _named(measure: str, kind: str) -> str:
    return measure.replace("n", kind, 1)


def _ranked_whole(counts: DataFrame, measures: list[str]) -> DataFrame:
    """Ranks of collapsed columns small enough to be sorted one per task."""
    upto = (Window.partitionBy("variable").orderBy("value")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = Window.partitionBy("variable")
    return counts.select("variable", "value", *[
        out for c in measures for out in (
            F.col(c), F.sum(c).over(upto).alias(_named(c, "cum")),
            F.sum(c).over(whole).alias(_named(c, "total")))
    ])


def value_ranks(df: DataFrame, values: dict[str, Column],
                masks: dict[str, Column] | None = None, sizes: dict[str, int] | None = None,
                buckets: int | None = None) -> DataFrame:
    """``variable, value, n, cum, total`` with running counts in value order.

    Each mask adds the same three columns suffixed ``_<mask>``. Columns are
    bucketed when one of them is wide or ``buckets`` asks for it. ``sizes`` are
    approximate distinct counts, looked up here when not given.
    """
    masks = masks or {}
    sizes = sizes or distinct_counts(df, values)
    measures = ["n", *[f"n_{m}" for m in masks]]
    if buckets is None and max(sizes.values()) <= DISTINCT_LIMIT:
        return _ranked_whole(value_counts(df, values, masks), measures)
    buckets = buckets or bucket_count(df)
    counts = value_counts(df, values, masks)

    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    splits = []
    for i, (name, v) in enumerate(values.items()):
        every = max(1, sizes[name] // (SAMPLE_PER_BUCKET * buckets))
        v = v.cast("double")
        chosen = F.when(F.pmod(F.xxhash64(v), F.lit(every)) == 0, v)
        splits.append(F.percentile(chosen, probs).alias(f"s{i}"))
    points = pick("variable", {name: F.col(f"_splits.s{i}") for i, name in enumerate(values)})
    steps = [F.lit(1 << b) for b in reversed(range(buckets.bit_length() - 1))]

    def advance(at: Column, step: Column) -> Column:
        # One halving step of a binary search for the splits at or below value.
        passed = F.get("_points", at + step - 1) <= F.col("value")
        return at + F.when(passed, step).otherwise(0)

    bucketed = (
        with_row(counts, df.agg(*splits), "_splits")
        .withColumn("_points", points)
        .withColumn("bucket", F.aggregate(F.array(*steps), F.lit(0), advance))
        .drop("_splits", "_points")
    )
    ordered = Window.partitionBy("variable").orderBy("bucket")
    whole = Window.partitionBy("variable")
    per_bucket = bucketed.groupBy("variable", "bucket").agg(
        *[F.sum(c).alias(f"b_{c}") for c in measures])
    # At most variables x buckets rows, so this broadcast has a fixed bound.
    offsets = per_bucket.select(
        "variable", "bucket",
        *[(F.sum(f"b_{c}").over(ordered) - F.col(f"b_{c}")).alias(f"before_{c}") for c in measures],
        *[F.sum(f"b_{c}").over(whole).alias(f"total_{c}") for c in measures],
    )
    inside = (Window.partitionBy("variable", "bucket").orderBy("value")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = bucketed.join(F.broadcast(offsets), ["variable", "bucket"])
    return ranked.select("variable", "value", *[
        out for c in measures for out in (
            F.col(c),
            (F.sum(c).over(inside) + F.col(f"before_{c}")).alias(_named(c, "cum")),
            F.col(f"total_{c}").alias(_named(c, "total")))
    ])


def average_rank(suffix: str = "") -> Column:
    """Rank of a value when ties share the mean of their positions."""
    n, cum = F.col(f"n{suffix}").cast("double"), F.col(f"cum{suffix}").cast("double")
    return F.when(n > 0, cum - (n - 1.0) / 2.0)


def _grouped(requests: list[Quantile]) -> dict[str, list[Quantile]]:
    groups: dict[tuple[str, int], list[Quantile]] = {}
    for q in requests:
        groups.setdefault((q.column, id(q.where)), []).append(q)
    return {f"g{i}": g for i, g in enumerate(groups.values())}


def _masked_value(q: Quantile) -> Column:
    col = F.col(q.column).cast("double")
    return col if q.where is None else F.when(q.where, col)


def _one_row(per_variable: DataFrame, groups: dict[str, list[Quantile]]) -> DataFrame:
    return per_variable.agg(*[
        F.max(F.when(F.col("variable") == name, F.get("qs", F.lit(j)))).alias(q.name)
        for name, group in groups.items() for j, q in enumerate(group)])


def _collapsed(df: DataFrame, groups: dict[str, list[Quantile]]) -> DataFrame:
    counts = value_counts(df, {name: _masked_value(g[0]) for name, g in groups.items()})
    probs = sorted({q.prob for g in groups.values() for q in g})
    table = counts.groupBy("variable").agg(
        F.percentile("value", F.array(*[F.lit(p) for p in probs]), F.col("n")).alias("all"))
    picked = pick("variable", {name: F.array(*[F.get("all", F.lit(probs.index(q.prob))) for q in g])
                           for name, g in groups.items()})
    return _one_row(table.select("variable", picked.alias("qs")), groups)


def _bucketed(df: DataFrame, groups: dict[str, list[Quantile]], sizes: dict[str, int]) -> DataFrame:
    values = {name: _masked_value(g[0]) for name, g in groups.items()}
    ranks = value_ranks(df, values, sizes=sizes, buckets=bucket_count(df))
    slots = max(len(g) for g in groups.values())
    aggs = []
    for j in range(slots):
        prob = pick("variable", {n: F.lit(g[j].prob) for n, g in groups.items() if len(g) > j})
        pos = prob * (F.col("total") - 1)
        lower = F.min(F.when(F.col("cum") > F.floor(pos), F.col("value")))
        upper = F.min(F.when(F.col("cum") > F.ceil(pos), F.col("value")))
        share = F.max(pos - F.floor(pos))
        aggs.append(F.when(lower == upper, lower).otherwise(
            (1.0 - share) * lower + share * upper))
    return _one_row(ranks.groupBy("variable").agg(F.array(*aggs).alias("qs")), groups)


def exact_quantiles(df: DataFrame, requests: list[Quantile],
                    distinct_limit: int = DISTINCT_LIMIT) -> DataFrame:
    """One row with one column per request: exact, linearly interpolated quantiles."""
    groups = _grouped(requests)
    open_values = {n: F.col(g[0].column) for n, g in groups.items() if not g[0].bounded}
    sizes = distinct_counts(df, open_values)
    large = {n: g for n, g in groups.items() if sizes.get(n, 0) > distinct_limit}
    small = {n: g for n, g in groups.items() if n not in large}
    if not large:
        return _collapsed(df, small)
    wide = _bucketed(df, large, sizes)
    if not small:
        return wide
    return with_row(_collapsed(df, small), wide, "_wide").select("*", "_wide.*").drop("_wide")


def quantile_table(df: DataFrame, cols: list[str], probs: list[float],
                   distinct_limit: int = DISTINCT_LIMIT) -> DataFrame:
    """Long table (Variable, prob, value) of exact quantiles."""
    requests = [Quantile(f"q{i}_{j}", c, p) for i, c in enumerate(cols) for j, p in enumerate(probs)]
    row = exact_quantiles(df, requests, distinct_limit)
    return row.select(rows_from_columns([
        F.struct(F.lit(q.column).alias("Variable"), F.lit(q.prob).alias("prob"),
                 F.col(q.name).alias("value")) for q in requests
    ]))
