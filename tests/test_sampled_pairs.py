"""Scatter samples against a plain sort, and what is left to sort."""

from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from normlens.functions.hashing import key_text, seeded_digest
from normlens.operators import correlate
from normlens.spec import NormSpec

PAIRS = (("a", "b"), ("a", "c"))


@pytest.fixture(scope="module")
def scattered(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), None if i % 5 == 0 else float(rng.normal()), None if i % 1000 else float(i)) for i in range(20_000)]
    return rows, spark.createDataFrame(rows, "id int, a double, b double, c double").repartition(7)


def test_scatter_samples_equal_a_plain_sort(scattered):
    rows, df = scattered
    got = {(r["x"], r["y"]): (r["n"], r["r"]) for r in correlate.scatter_corr(df, PAIRS, ["id"], NormSpec(scatter_rows=300)).collect()}
    for pair, at in zip(PAIRS, (2, 3)):
        held = sorted((md5(f"42:{r[0]}".encode()).hexdigest(), r[1], r[at]) for r in rows if r[at] is not None)[:300]
        want = np.corrcoef([h[1] for h in held], [h[2] for h in held])[0, 1]
        assert got[pair] == (len(held), pytest.approx(want, abs=6e-4))


def test_only_rows_about_as_many_as_the_samples_are_sorted(scattered):
    _, df = scattered
    marked = df.withColumn("_digest", seeded_digest(42, key_text(["id"]))).withColumn("_bits", correlate._digest_bits(F.col("_digest")))
    rules = [F.col(x).isNotNull() & F.col(y).isNotNull() for x, y in PAIRS]
    cut = correlate._sample_bits(marked, rules, 300).first()
    left = marked.agg(*[F.count_if(rule & (F.col("_bits") <= bits)) for rule, bits in zip(rules, cut)]).first()
    assert 300 <= left[0] < 1000  # of 16,000
    assert cut[1] == 32 and left[1] == 20  # fewer than a sample has: all of them
    assert "_cut" in correlate.scatter_corr(df, PAIRS, ["id"])._jdf.queryExecution().analyzed().toString()
