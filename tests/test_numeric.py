import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from normlens.functions.numeric import (
    direction_label, fixed_text, in_band, pearson, rescale, round_even, row_mean, strength_label, two_sided_p)


def one(spark, expr, **values):
    schema = ", ".join(f"{k} double" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("v")).first()["v"]


def test_round_even_equals_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=2000) * 10, np.arange(-20, 20) / 8 + 0.0])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    for digits in (2, 4, 6):
        got = [r[0] for r in df.select(round_even("x", digits)).collect()]
        assert np.array_equal(np.array(got), np.round(values, digits))


def test_row_mean_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (None, None, None), (4.0, 5.0, 9.0)],
                               "a double, b double, c double")
    assert [r[0] for r in df.select(row_mean(["a", "b", "c"])).collect()] == [1.5, None, 6.0]


def test_rescale_range_and_empty_range(spark):
    assert one(spark, rescale("x", F.lit(0.0), F.lit(4.0)), x=1.0) == 0.25
    assert one(spark, rescale("x", F.lit(0.0), F.lit(4.0), to=(-1.0, 1.0)), x=1.0) == -0.5
    assert one(spark, rescale("x", F.lit(2.0), F.lit(2.0)), x=2.0) is None


def test_pearson_constant_side_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "a double, b double")
    assert df.agg(pearson("a", "b")).first()[0] is None
    line = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (5.0, None)], "a double, b double")
    assert line.agg(pearson("a", "b")).first()[0] == pytest.approx(1.0)


def test_labels(spark):
    df = spark.createDataFrame([(0.7,), (-0.4,), (0.2,), (0.1999,), (0.0,), (None,)], "r double")
    assert [tuple(r) for r in df.select(strength_label("r"), direction_label("r")).collect()] == [
        ("Strong", "positive"), ("Moderate", "negative"), ("Weak", "positive"), ("Negligible", "positive"),
        ("Negligible", "N/A"), ("N/A (column missing)", "N/A")]


def test_band_is_closed_and_null_is_outside(spark):
    df = spark.createDataFrame([(2.75,), (3.25,), (3.2501,), (None,)], "v double")
    assert [r[0] for r in df.select(in_band("v", 2.75, 3.25)).collect()] == [True, True, False, False]


def test_fixed_text_has_no_grouping(spark):
    assert one(spark, fixed_text("x", 4), x=36123.125) == "36123.1250"


def p_reference(r, n, steps=400_000):
    """Tail of the t density by plain numeric integration, independent of the angle form."""
    k = n - 2
    t = abs(r) * math.sqrt(k / (1 - r * r))
    const = math.exp(math.lgamma((k + 1) / 2) - math.lgamma(k / 2)) / math.sqrt(k * math.pi)
    x = np.linspace(0, t, steps + 1)
    f = const * (1 + x * x / k) ** (-(k + 1) / 2)
    inside = np.sum((f[1:] + f[:-1]) / 2) * t / steps
    return 1 - 2 * inside


@pytest.mark.parametrize("r,n", [(0.3, 10), (-0.62, 12), (0.0337, 6000), (0.01, 1_000_000), (0.9, 5), (0.0, 50)])
def test_p_value(spark, r, n):
    got = one(spark, two_sided_p("r", "n"), r=r, n=float(n))
    assert got == pytest.approx(p_reference(r, n), abs=2e-7)


def test_p_value_edges(spark):
    assert one(spark, two_sided_p("r", "n"), r=1.0, n=100.0) == pytest.approx(0.0, abs=1e-12)
    assert one(spark, two_sided_p("r", "n"), r=0.5, n=2.0) == 1.0
    assert one(spark, two_sided_p("r", "n"), r=None, n=10.0) is None
