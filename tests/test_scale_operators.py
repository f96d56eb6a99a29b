"""Operators whose plan matters: ranks in two shuffles, shared solves, sketches, balanced folds, caches."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from normlens.operators import audit, benchmark, density, folds, joint_ranks, ngram_ridge, ridge, sketches, topk, vectors
from normlens.operators.correlate import spearman_matrix
from normlens.sources import tables
from normlens.sources.vectors import write_bucketed_vectors
from normlens.spec import NormSpec
from test_text_and_vectors import dense_tfidf, nested


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- ranks ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def holed(spark):
    rng = np.random.default_rng(9)
    n = 4000
    pdf = pd.DataFrame({
        "wide": rng.lognormal(size=n), "hot": np.where(rng.random(n) < 0.5, -1.25, rng.normal(size=n)),
        "two": rng.integers(0, 2, n).astype(float), "gap": np.where(rng.random(n) < 0.4, np.nan, rng.normal(size=n).round(1)),
        "thin": np.where(rng.random(n) < 0.99, np.nan, rng.normal(size=n)), "none": np.full(n, np.nan)})
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.to_numpy()]
    return pdf, spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf)).repartition(7)


def test_spearman_with_hot_values_and_gaps(holed):
    pdf, df = holed
    got = spearman_matrix(df, list(pdf)).toPandas().set_index(["var_a", "var_b"])
    for a in pdf:
        for b in pdf:
            both = pdf[[a, b]].dropna() if a != b else pdf[[a]].dropna()
            assert got.loc[(a, b), "n"] == len(both)
            want = both.rank().corr().to_numpy()[0, -1] if len(both) > 1 else np.nan
            r = got.loc[(a, b), "r"]
            assert (pd.isna(r) and pd.isna(want)) or r == pytest.approx(want, abs=1e-4), (a, b)


def test_values_at_repeated_splits_have_their_own_bucket():
    buckets = joint_ranks.Buckets(np.array([[1.0, 2.0, 2.0, 2.0, 3.0]]))
    at, own = buckets.place(0, np.array([0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 9.0]))
    assert at.tolist() == [0, 0, 1, 2, 4, 4, 5] and own.tolist() == [False, False, False, True, False, False, False]


@pytest.mark.parametrize("buckets,per_bucket", [(16, 1), (64, 4)])
def test_ranks_do_not_depend_on_the_splits(holed, monkeypatch, buckets, per_bucket):
    pdf, df = holed
    monkeypatch.setattr(joint_ranks, "BUCKETS", buckets)
    monkeypatch.setattr(joint_ranks, "SAMPLE_PER_BUCKET", per_bucket)
    got = spearman_matrix(df, ["wide", "hot", "gap"]).toPandas().set_index(["var_a", "var_b"]).r
    want = pdf[["wide", "hot", "gap"]].corr(method="spearman").round(4)
    assert all(got[a, b] == pytest.approx(want.loc[a, b], abs=1e-4) for a in want for b in want)


def test_spearman_has_two_shuffles_and_no_join(holed):
    pdf, df = holed
    text = plan(spearman_matrix(df, list(pdf)))
    # The third exchange carries the sums of pairs.
    assert text.count("Exchange hashpartitioning") == 3 and "Join" not in text


# -- ridge ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def rated(spark):
    rng = np.random.default_rng(6)
    seen = sorted({"".join(rng.choice(list("aeinrst"), rng.integers(1, 7))) for _ in range(300)})
    rows = []
    for i, w in enumerate(seen):
        e = float(w.count("e")) + rng.normal() / 4
        rows.append((w, float(len(w)) + rng.normal(), None if i % 3 == 0 else e, None if i % 3 == 0 else e * 2 + rng.normal(),
                     None if i % 4 == 1 else float(w.count("a")), [float(len(w)), float(w.count("a")), float(rng.normal())]))
    df = spark.createDataFrame(rows, "w string, y double, z double, z2 double, u double, emb array<float>")
    return folds.assign_folds(df, ["w"]).cache()


TARGETS = ("y", "z", "z2", "u")


def test_ngram_ridge_of_several_targets_and_gaps(rated):
    spec = NormSpec(solver_tolerance=1e-10)
    got = ngram_ridge.ngram_predictions(rated, "w", "w", TARGETS, spec).toPandas()
    for target in TARGETS:
        pdf = rated.toPandas().dropna(subset=[target])
        want = nested(pdf, target, lambda fit, rows: dense_tfidf(list(fit.w), list(rows.w))[0], spec.ridge_alphas)
        mine = got[got.target == target].set_index("key")
        assert len(mine) == len(pdf)
        for alpha, held, predicted in want.values():
            assert np.allclose(mine.loc[held.w, "prediction"], predicted, atol=1e-5)
            assert set(mine.loc[held.w, "alpha"]) == {alpha}


def test_targets_with_the_same_gaps_share_their_designs(rated):
    search = ngram_ridge.NgramSearch(rated, "w", "w", TARGETS)
    try:
        assert len(search.designs) == 3 * 20 and len(search.design_of) == 4 * 20
        assert (search.design_of[20:40] == search.design_of[40:60]).all()
    finally:
        search.close()


def test_partial_sums_merge_by_blocks_and_groups(rated, monkeypatch):
    spec = NormSpec(ridge_alphas=(1.0,), solver_tolerance=1e-8)
    want = ngram_ridge.ngram_predictions(rated, "w", "w", ("y", "z"), spec).toPandas()
    for name, value in (("ROWS_PER_TASK", 20), ("DIRECT_TASKS", 2), ("FAN_IN", 3), ("BLOCK", 32), ("CELLS", 100)):
        monkeypatch.setattr(ngram_ridge, name, value)
    got = ngram_ridge.ngram_predictions(rated.repartition(12), "w", "w", ("y", "z"), spec).toPandas()
    both = want.merge(got, on=["key", "target"])
    assert len(both) == len(want) and np.allclose(both.prediction_x, both.prediction_y, atol=1e-6)


def test_dense_ridge_of_several_targets_and_gaps(rated):
    spec = NormSpec()
    got = ridge.dense_cv(rated, "emb", TARGETS, 3, spec).toPandas().set_index(["target", "outer_fold"])
    for target in TARGETS:
        pdf = rated.toPandas().dropna(subset=[target])
        want = nested(pdf, target, lambda fit, rows: np.stack(rows.emb.to_numpy()).astype("float64"), spec.ridge_alphas)
        for outer, (_, held, predicted) in want.items():
            error = held[target].to_numpy() - predicted
            row = got.loc[(target, outer)]
            assert row.n == len(held)
            assert row.MAE == pytest.approx(np.abs(error).mean(), abs=1e-4)
            assert row.Pearson_r == pytest.approx(np.corrcoef(held[target], predicted)[0, 1], abs=1e-4)


def test_vectors_of_another_length_raise(rated):
    with pytest.raises(Exception, match="vectors must have 4 values"):
        ridge.dense_cv(rated, "emb", ["y"], 4).collect()


def test_benchmark_grid(rated):
    table = benchmark.benchmark(rated, "w", TARGETS, text="w", vectors={"Static vectors": ("emb", 3)}).toPandas()
    families = {"Dummy (mean predictor)", "Character n-grams (TF-IDF, char_wb 2-4)", "Static vectors"}
    assert set(zip(table.Target, table.Representation)) == {(t, f) for t in TARGETS for f in families}
    rmse = table.set_index(["Target", "Representation"]).RMSE_mean
    assert all(rmse[t, "Character n-grams (TF-IDF, char_wb 2-4)"] < rmse[t, "Dummy (mean predictor)"] for t in TARGETS)


# -- folds ------------------------------------------------------------------------

def test_balanced_folds(spark):
    keys = [f"k{i}" for i in range(1003)] + [None]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys * 2)], "w string, i int").repartition(9)
    made = folds.assign_balanced_folds(df, ["w"])
    rows = made.toPandas()
    assert len(rows) == 2 * len(keys)
    once = rows.drop_duplicates(["w", "outer_fold", "inner_fold"])
    assert len(once) == len(keys)  # rows of one key share its folds
    for name in ("outer_fold", "inner_fold"):
        sizes = once[name].value_counts()
        assert sizes.max() - sizes.min() <= 1
    again = folds.assign_balanced_folds(df.repartition(3), ["w"]).toPandas()
    assert rows.sort_values("i").outer_fold.tolist() == again.sort_values("i").outer_fold.tolist()


def test_hash_ranks_are_a_permutation(spark):
    df = spark.range(777).select(F.col("id").cast("string").alias("w"))
    places = [r.place for r in folds.hash_ranks(df, F.col("w"), 1, ["w"]).collect()]
    assert sorted(places) == list(range(777))


# -- sketches and densities -----------------------------------------------------------

def test_sketches_of_parts_merge_into_the_whole(spark):
    rng = np.random.default_rng(2)
    x = rng.lognormal(size=30_000)
    rows = spark.createDataFrame(pd.DataFrame({"day": np.arange(len(x)) % 7, "x": x, "gap": np.where(x > 1, np.nan, 5.0)}))
    daily = sketches.sketch_columns(tables.nan_to_null(rows), ["x", "gap"], by=["day"], k=400)
    assert daily.count() == 14
    got = sketches.quantiles_of(sketches.merge_sketches(daily), [0.1, 0.5, 0.99]).toPandas()
    ordered = np.sort(x)
    for row in got[got.Variable == "x"].itertuples():
        assert row.n == len(x)
        assert abs(np.searchsorted(ordered, row.value) / len(x) - row.prob) <= 2 * sketches.rank_error(400)
    assert set(got[got.Variable == "gap"].value) == {5.0}


def test_sketch_ranks_are_checked_exactly(spark):
    df = spark.createDataFrame([(float(i % 10), None) for i in range(1000)], "x double, empty double")
    found = spark.createDataFrame([("x", 0.5, 1000, 4.0), ("x", 0.9, 1000, 2.0)], "Variable string, prob double, n long, value double")
    ranks = {r.prob: (r.low, r.high) for r in sketches.quantile_ranks(df, found, ["x", "empty"]).collect()}
    assert ranks == {0.5: (0.4, 0.5), 0.9: (0.2, 0.3)}
    assert all(r.within for r in sketches.quantile_check(df, ["x", "empty"], [0.25, 0.5]).collect())


@pytest.mark.parametrize("tolerance", [1e-3, 1e-6])
def test_binned_density_is_within_its_bound(spark, tolerance):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"Valence": rng.normal(3, 0.5, 2000), "PositiveAffect": np.where(rng.random(2000) < 0.5, 1.0, rng.random(2000)),
                        "NegativeAffect": np.full(2000, 2.0)})
    df = spark.createDataFrame(pdf).repartition(4)
    got = density.kde_binned(df, tolerance=tolerance).toPandas()
    assert set(got.Variable) == {"Valence", "PositiveAffect"} and (got.error_bound <= tolerance * 1.0001).all()
    for c in ("Valence", "PositiveAffect"):
        x = pdf[c].to_numpy()
        h = x.std(ddof=1) * len(x) ** -0.2
        grid = np.linspace(x.min(), x.max(), 300)
        want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
        mine = got[got.Variable == c].sort_values("point")
        assert np.abs(mine.density - want).max() <= tolerance * 1.0001


# -- audit and exemplars ------------------------------------------------------------

def test_duplicates_tell_nulls_by_their_place(spark):
    rows = [(None, "a"), ("a", None), (None, "a"), (None, None), (None, None), (None, None), ("a", "a"), ("aa", "")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert audit.duplicate_rows(df).first()[0] == 3
    assert audit.duplicate_rows(df.limit(0)).first()[0] == 0
    wide = df.select(*[F.col("x").alias(f"c{i}") for i in range(40)])
    assert audit.duplicate_rows(wide).first()[0] == 8 - 3
    first = plan(audit.duplicate_rows(wide))
    assert re.search(r"hashpartitioning\(_f1#\d+L, _f2#\d+L", first)


def test_exemplars_come_from_one_ranked_scan(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"w{i}", *map(float, rng.integers(1, 6, 3)), round(float(rng.random()), 2)) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, Word string, Valence double, PositiveAffect double, NegativeAffect double, "
                                     "Ambivalence_product double")
    made = topk.exemplars(df, ["id"])
    text = plan(made)
    assert text.count("WindowGroupLimit") >= 2 and "TakeOrdered" not in text and text.count("Union") == 0
    pdf = pd.DataFrame(rows, columns=["id", "Word", "v", "pa", "na", "s"])
    low, high = pdf[(pdf.v >= 2.75) & (pdf.v <= 3.25)], pdf.quantile(0.75, numeric_only=True)
    want = low[low.s <= low.s.median()].sort_values(["s", "id"]).head(10).id.tolist()
    got = made.where("Category = 'Near-neutral, Low Ambivalence'").toPandas().sort_values(["Ambivalence_product", "id"]).id.tolist()
    assert got == want
    top = pdf[(pdf.pa >= high.pa) & (pdf.na <= pdf.na.quantile(0.25))].sort_values(["pa", "id"], ascending=[False, True]).head(10)
    assert set(made.where("Category like 'High Pos%'").toPandas().id) == set(top.id)


# -- caches, buckets, reports ---------------------------------------------------------

def test_compute_or_reuse(spark, tmp_path):
    source, path, calls = str(tmp_path / "in"), str(tmp_path / "cache"), []
    spark.range(10).write.parquet(source)

    def ask(settings, broken=False):
        read = spark.read.parquet(source)

        def build():
            calls.append(settings)
            return read.select((F.col("id") * settings["k"]).alias("v"), F.raise_error(F.lit("stop")).alias("x")) if broken else \
                read.select((F.col("id") * settings["k"]).alias("v"))
        return sorted(r.v for r in tables.compute_or_reuse(spark, path, build, settings, [read]).collect())
    with pytest.raises(Exception, match="stop"):
        ask({"k": 2}, broken=True)
    assert ask({"k": 2}) == ask({"k": 2}) == [2 * i for i in range(10)] and len(calls) == 2
    assert ask({"k": 3}) == [3 * i for i in range(10)] and len(calls) == 3
    assert ask({"k": 2})[-1] == 18 and len(calls) == 3
    spark.range(10, 20).write.mode("append").parquet(source)  # changed input
    assert ask({"k": 2})[-1] == 38 and len(calls) == 4
    assert not [p.name for p in (tmp_path / "cache").iterdir() if p.name.startswith("_draft")]
    for data in (tmp_path / "cache").glob("data-*/part-*.parquet"):  # lost rows
        data.unlink()
    assert ask({"k": 2})[-1] == 38 and len(calls) == 5


def test_bucketed_lookup_shuffles_words_only(spark, tmp_path):
    known = spark.createDataFrame([(f"w{i}", [float(i), 1.0]) for i in range(50)], "w string, emb array<float>")
    stored = write_bucketed_vectors(known, "bucketed_vectors_test", str(tmp_path / "v"), "w", 16)
    words = spark.createDataFrame([("w3",), ("x",), (None,), ("w3",)], "w string")
    found = vectors.lookup_bucketed(words, stored, "w", 2)
    assert sorted((r.w or "", list(r.emb), r.oov) for r in found.collect()) == [
        ("", [0.0, 0.0], True), ("w3", [3.0, 1.0], False), ("w3", [3.0, 1.0], False), ("x", [0.0, 0.0], True)]
    fresh = vectors.lookup_bucketed(words, stored, "w", 2)
    assert plan(fresh).count("Exchange") == 1
    assert vectors.lookup_bucketed(words, stored, "w", 2, unknown="random").where("oov").count() == 2


def test_reports_are_ordered(spark, tmp_path):
    table = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("a", 1)], "label string, n int").repartition(4)
    tables.write_report(table, str(tmp_path / "r"), order_by=["label", "n"])
    text = next((tmp_path / "r").glob("*.csv")).read_text().splitlines()
    assert text == ["label,n", "a,1", "a,2", "b,1", '"",3'] or text == ["label,n", "a,1", "a,2", "b,1", ",3"]
