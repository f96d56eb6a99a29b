import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from normlens.operators import density
from normlens.operators.correlate import pearson_matrix, spearman_matrix, spearman_pair
from normlens.operators.ranking import Quantile, average_rank, exact_quantiles, quantile_table, value_ranks

COLS = ["near_unique", "likert", "holed", "hot", "constant"]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({
        "near_unique": rng.lognormal(size=n),
        "likert": rng.integers(1, 6, n).astype(float),
        "holed": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n).round(1)),
        "hot": np.where(rng.random(n) < 0.4, 2.5, rng.normal(size=n)),
        "constant": np.full(n, 0.1),
    })
    pdf.loc[:20, "near_unique"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def df(spark, frame):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in frame.to_numpy()]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in COLS)).repartition(5)


@pytest.mark.parametrize("limit", [1 << 20, 100, 0])
def test_quantiles_equal_pandas(df, frame, limit):
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = quantile_table(df, COLS, probs, distinct_limit=limit).toPandas()
    for row in got.itertuples():
        assert row.value == pytest.approx(frame[row.Variable].quantile(row.prob), abs=1e-12)


def test_masked_quantile_uses_subset(df, frame):
    inside = F.col("likert") >= 4
    for limit in (1 << 20, 10):
        row = exact_quantiles(df, [Quantile("m", "near_unique", 0.5, where=inside),
                                   Quantile("all", "near_unique", 0.5)], distinct_limit=limit).first()
        assert row["m"] == pytest.approx(frame.loc[frame.likert >= 4, "near_unique"].median())
        assert row["all"] == pytest.approx(frame.near_unique.median())


@pytest.mark.parametrize("buckets", [None, 16, 64])
def test_average_ranks_equal_pandas(df, frame, buckets):
    ranks = value_ranks(df, {c: F.col(c) for c in COLS}, buckets=buckets).select(
        "variable", "value", average_rank().alias("rank"), "total").toPandas()
    for c in COLS:
        want = dict(zip(frame[c], frame[c].rank()))
        mine = ranks[ranks.variable == c]
        assert len(mine) == frame[c].nunique()
        assert (mine.total == frame[c].count()).all()
        assert np.allclose(mine["rank"], [want[v] for v in mine.value])


@pytest.mark.parametrize("method,build", [("pearson", pearson_matrix), ("spearman", spearman_matrix)])
def test_matrices_equal_pandas(df, frame, method, build):
    want = frame[COLS].corr(method=method).round(4)
    got = build(df, COLS).toPandas()
    assert len(got) == len(COLS) ** 2
    for row in got.itertuples():
        expected = want.loc[row.var_a, row.var_b]
        if np.isnan(expected) or "constant" in (row.var_a, row.var_b):
            assert row.r is None or np.isnan(row.r)
        else:
            assert row.r == pytest.approx(expected, abs=1e-4)
        both = frame[[row.var_a, row.var_b]].dropna() if row.var_a != row.var_b else frame[[row.var_a]].dropna()
        assert row.n == len(both)


def test_large_offset_keeps_precision(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=500)
    y = x + rng.normal(size=500)
    df = spark.createDataFrame([(float(a) + 1e9, float(b) - 1e9) for a, b in zip(x, y)], "x double, y double")
    got = pearson_matrix(df, ["x", "y"]).where("idx_a = 0 AND idx_b = 1").first()["r"]
    assert got == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-4)


def test_spearman_pair(df, frame):
    both = frame[["holed", "hot"]].dropna()
    row = spearman_pair(df, "holed", "hot").first()
    assert row["n"] == len(both)
    assert row["r"] == pytest.approx(both.rank().corr().iloc[0, 1])


@pytest.mark.parametrize("bins", [7, 50])
def test_histogram_equals_numpy(df, frame, bins):
    got = density.histogram(df, COLS, bins=bins).toPandas()
    for c in COLS:
        want, edges = np.histogram(frame[c].dropna(), bins=bins)
        mine = got[got.Variable == c].sort_values("bin")
        assert mine.n.tolist() == want.tolist()
        assert np.allclose(mine.bin_left, edges[:-1], atol=1e-6)
        assert (mine.density * (edges[1] - edges[0])).sum() == pytest.approx(1.0, abs=1e-4)


@pytest.mark.parametrize("collapse", [1 << 20, 0])
def test_kde_equals_direct_sum(df, frame, monkeypatch, collapse):
    monkeypatch.setattr(density, "COLLAPSE_LIMIT", collapse)
    got = density.kde_curve(df, COLS).toPandas()
    assert "constant" not in set(got.Variable)
    for c in COLS[:-1]:
        x = frame[c].dropna().to_numpy()
        h = x.std(ddof=1) * len(x) ** -0.2
        grid = np.linspace(x.min(), x.max(), 300)
        want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
        mine = got[got.Variable == c].sort_values("point")
        assert np.allclose(mine.density, want, atol=1e-6)
