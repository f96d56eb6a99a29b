"""Pearson and Spearman tables, pairwise complete."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normlens import spec as S
from normlens.functions.hashing import hash_number, key_text, seeded_digest
from normlens.functions.numeric import (
    direction_label, pearson, round_even, rows_from_columns, strength_label, two_sided_p)
from normlens.operators.joint_ranks import SUMS, rank_sums
from normlens.plans.relational import available_columns, with_row
from normlens.spec import DEFAULT_SPEC, NormSpec


def _pair_sums(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Sums behind each pair's correlation: (pair, n, sx, sy, sxx, syy, sxy).

    A wide table of pair aggregates outgrows generated code, so each task adds
    up its own rows with array arithmetic and emits one record per pair; the
    merge is an ordinary grouped sum of pairs x tasks records. Columns are
    shifted to around zero first, which keeps the sums well conditioned.
    """
    names = list(dict.fromkeys(c for p in pairs for c in p))
    where = {c: i for i, c in enumerate(names)}
    index = [(where[a], where[b]) for a, b in pairs]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(index), len(SUMS)))
        for batch in batches:
            values = [batch[c].to_numpy(dtype="float64", na_value=np.nan) for c in names]
            seen = [~np.isnan(v) for v in values]
            for k, (i, j) in enumerate(index):
                both = seen[i] & seen[j]
                x, y = (values[i], values[j]) if both.all() else (values[i][both], values[j][both])
                total[k] += (len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y)
        yield pd.DataFrame({"pair": np.arange(len(index)), **{c: total[:, m] for m, c in enumerate(SUMS)}})

    middle = df.agg(*[F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.avg(c)).alias(c) for c in names])
    shifted = with_row(df.select(*names), middle, "_c").select(*[(F.col(c) - F.col(f"_c.{c}")).alias(c) for c in names])
    schema = "pair int, " + ", ".join(f"{c} double" for c in SUMS)
    return shifted.mapInPandas(partial, schema).groupBy("pair").agg(
        *[F.sum(c).alias(c) for c in SUMS])


def _r_from_sums() -> Column:
    """Pearson r of summed moments; NULL when a side is constant.

    A spread at the level of rounding noise counts as constant.
    """
    def spread(total: str, squares: str) -> Column:
        raw = F.col(squares) - F.try_divide(F.col(total) * F.col(total), F.col("n"))
        return F.when(raw > 1e-13 * F.col(squares), raw)

    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    return F.try_divide(cov, F.sqrt(spread("sx", "sxx") * spread("sy", "syy")))


def _square(sums: DataFrame, cols: list[str]) -> DataFrame:
    """Long square matrix from the sums of the pairs (i, j), i <= j."""
    upper = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    names = F.array(*[F.lit(c) for c in cols])
    ends = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in upper])
    flat = sums.select(F.get(ends, "pair").alias("at"), F.col("n").cast("long").alias("n"),
                       round_even(_r_from_sums(), 4).alias("r"))
    both = F.when(F.col("at.i") == F.col("at.j"), F.array("at")).otherwise(
        F.array(F.col("at"), F.struct(F.col("at.j").alias("i"), F.col("at.i").alias("j"))))
    cells = flat.select(F.inline(both).alias("idx_a", "idx_b"), "n", "r")
    return cells.select("idx_a", "idx_b", F.get(names, "idx_a").alias("var_a"),
                        F.get(names, "idx_b").alias("var_b"), "n", "r")


def pearson_matrix(df: DataFrame, variables: Sequence[str] = S.STAT_VARIABLES) -> DataFrame:
    """Long square matrix (idx_a, idx_b, var_a, var_b, n, r) over pairwise-complete rows."""
    cols = available_columns(df, list(variables))
    return _square(_pair_sums(df, [(a, b) for i, a in enumerate(cols) for b in cols[i:]]), cols)


def spearman_matrix(df: DataFrame, variables: Sequence[str] = S.STAT_VARIABLES) -> DataFrame:
    """Spearman counterpart of ``pearson_matrix``; ranks are taken over each pair's complete rows."""
    cols = available_columns(df, list(variables))
    return _square(rank_sums(df, cols), cols)


def spearman_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, r) for a single pair over its complete rows, r unrounded."""
    complete = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return rank_sums(complete, [a, b]).where("pair = 1").select(F.col("n").cast("long").alias("n"), _r_from_sums().alias("r"))


def lower_triangle(matrix: DataFrame) -> DataFrame:
    """Keep the diagonal and everything below it."""
    return matrix.where(F.col("idx_a") >= F.col("idx_b"))


def construct_checks(df: DataFrame, checks: Sequence[tuple[str, str, str]] = S.CONSTRUCT_QUESTIONS
                     ) -> DataFrame:
    """The key construct questions: r, p, strength and direction per pair.

    A pair with an absent column stays in the table with NULL numbers. Labels
    are derived from the rounded r.
    """
    usable = {q: a in df.columns and b in df.columns for q, a, b in checks}
    aggs = [F.lit(1).alias("one")]
    for k, (q, a, b) in enumerate(checks):
        if usable[q]:
            aggs += [pearson(a, b).alias(f"r{k}"), F.regr_count(F.col(a), F.col(b)).alias(f"n{k}")]
        else:
            aggs += [F.lit(None).cast("double").alias(f"r{k}"), F.lit(0).cast("long").alias(f"n{k}")]
    wide = df.agg(*aggs)
    rows = wide.select(rows_from_columns([
        F.struct(F.lit(q).alias("Question"), F.lit(a).alias("Variable_A"), F.lit(b).alias("Variable_B"),
                 F.col(f"n{k}").alias("n"), F.col(f"r{k}").alias("raw"))
        for k, (q, a, b) in enumerate(checks)
    ]))
    r = round_even("raw", 4)
    return rows.select(
        "Question", "Variable_A", "Variable_B",
        r.alias("Pearson_r"),
        round_even(two_sided_p("raw", "n"), 6).alias("p_value"),
        strength_label(r).alias("Strength"),
        direction_label(r).alias("Direction"),
    )


def _digest_bits(digest: Column) -> Column:
    """Bits of the first 32 of a digest from the first one that is set: half of all rows have 32, a quarter 31, and so on."""
    return F.length(F.bin(hash_number(digest)))


def _sample_bits(rows: DataFrame, complete: Sequence[Column], most: int) -> DataFrame:
    """One row (b0, b1, ...): for each rule the least number of digest bits that at least ``most`` of its rows stay within.

    The rows with the ``most`` lowest digests are among them. One scan passes on a count for each number of bits.
    """
    names = [f"n{k}" for k in range(len(complete))]
    counts = rows.groupBy("_bits").agg(*[F.count_if(c).alias(n) for c, n in zip(complete, names)])
    upto = Window.orderBy("_bits").rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.select("_bits", *[F.sum(n).over(upto).alias(n) for n in names])
    return reached.agg(*[F.coalesce(F.min(F.when(F.col(n) >= most, F.col("_bits"))), F.lit(32)).alias(f"b{k}")
                         for k, n in enumerate(names)])


def scatter_corr(df: DataFrame, pairs: Sequence[tuple[str, str]], key: list[str],
                 spec: NormSpec = DEFAULT_SPEC) -> DataFrame:
    """Pearson r (3 decimals) on each pair's seeded scatter sample, all pairs in two scans.

    A row counts for every pair that it is complete for. The sample has the
    lowest digests, so a first scan finds how low they are: only rows about as
    many as the samples have are sorted and sent, however large the table is.
    """
    complete = [F.col(x).isNotNull() & F.col(y).isNotNull() for x, y in pairs]
    marked = df.withColumn("_digest", seeded_digest(spec.seed, key_text(key))).withColumn("_bits", _digest_bits(F.col("_digest")))
    cut = with_row(marked, _sample_bits(marked, complete, spec.scatter_rows), "_cut")
    taken = F.filter(F.array(*[
        F.when(c & (F.col("_bits") <= F.col(f"_cut.b{k}")),
               F.struct(F.lit(k).alias("pair"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
        for k, (c, (x, y)) in enumerate(zip(complete, pairs))]), lambda p: p.isNotNull())
    rows = cut.select(*key, "_digest", F.inline(taken))
    first = Window.partitionBy("pair").orderBy("_digest", *key)
    sample = rows.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= spec.scatter_rows)
    names = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in pairs])
    summed = sample.groupBy("pair").agg(F.count("*").alias("n"), round_even(pearson("x", "y"), 3).alias("r"))
    return summed.select(F.get(names, "pair").alias("p"), "n", "r").select("p.x", "p.y", "n", "r")
