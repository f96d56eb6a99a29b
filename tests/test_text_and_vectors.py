import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from normlens.functions.text import char_ngrams
from normlens.operators import benchmark, folds, metrics, ngram_ridge, ngrams, ridge, vectors
from normlens.sources import tables
from normlens.sources.vectors import (
    read_vector_cache, read_vector_text, write_vector_cache, write_vector_text)
from normlens.spec import NormSpec


def grams_of(text, low=2, high=4):
    out = []
    for word in text.lower().split():
        padded = f" {word} "
        for n in range(low, high + 1):
            if n >= len(padded):
                out.append(padded)
                break
            out += [padded[i:i + n] for i in range(len(padded) - n + 1)]
    return out


@pytest.mark.parametrize("low,high", [(2, 4), (1, 3), (3, 5)])
def test_char_ngrams_equal_a_plain_loop(spark, low, high):
    texts = ["a", "Be", "zee", "élan VITAL", "", "  two   words ", "x" * 40, "ijs-co", "nbsp split"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(df.select("i", char_ngrams("t", (low, high))).collect())
    assert [got[i] for i in range(len(texts))] == [grams_of(t, low, high) for t in texts]


@pytest.fixture(scope="module")
def words(spark):
    rng = np.random.default_rng(5)
    seen = sorted({"".join(rng.choice(list("aeinrst"), rng.integers(1, 7))) for _ in range(260)})
    rows = [(w, float(len(w)) + 2.0 * w.count("a") + float(rng.normal()), None if i % 3 == 0 else float(w.count("e")))
            for i, w in enumerate(seen)]
    return folds.assign_folds(spark.createDataFrame(rows, "w string, y double, z double"), ["w"]).cache()


def dense_tfidf(train, texts, min_df=3):
    counts = [pd.Series(grams_of(t)).value_counts().to_dict() if t else {} for t in train]
    df = pd.Series([g for c in counts for g in c]).value_counts()
    vocab = sorted(df[df >= min_df].index)
    idf = np.array([np.log((1 + len(train)) / (1 + df[g])) + 1 for g in vocab])
    at = {g: i for i, g in enumerate(vocab)}
    x = np.zeros((len(texts), len(vocab)))
    for r, t in enumerate(texts):
        for g in grams_of(t):
            if g in at:
                x[r, at[g]] += 1
    x *= idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1), vocab


def test_tfidf_equals_a_plain_computation(words):
    texts = [r["w"] for r in words.select("w").collect()]
    x, vocab = dense_tfidf(texts, texts)
    got = {(r["w"], r["gram"]): r["weight"] for r in ngrams.tfidf(words, "w", "w").collect()}
    want = {(t, g): x[i, j] for i, t in enumerate(texts) for j, g in enumerate(vocab) if x[i, j] > 0}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_vocabulary_cap_is_a_total_order(words):
    spec = NormSpec(max_features=15)
    terms = ngrams.term_counts(words.repartition(5), "w", "w")
    whole = ngrams.vocabulary(terms).toPandas().sort_values(["tf", "gram"], ascending=[False, True])
    assert set(whole.gram[:15]) == {r["gram"] for r in ngrams.vocabulary(terms, spec).collect()}


def test_feature_report_counts_null_words(spark):
    df = spark.createDataFrame([("abc",), ("abd",), ("abe",), (None,)], "w string")
    row = ngrams.feature_report(df, "w", "w").first()
    assert row["Coverage"] == "3/4 words" and row["Dimensionality"] == 3


def test_folds_are_stable_disjoint_and_near_balanced(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("w"))
    a = {r["w"]: (r["outer_fold"], r["inner_fold"]) for r in folds.assign_folds(df, ["w"]).collect()}
    b = {r["w"]: (r["outer_fold"], r["inner_fold"]) for r in folds.assign_folds(df.repartition(11), ["w"]).collect()}
    assert a == b and len(a) == 5000
    sizes = pd.Series(list(a.values())).value_counts()
    assert len(sizes) == 15 and sizes.min() > 250 and sizes.max() < 420


def test_target_gate(words):
    assert folds.usable_targets(words, ["y", "z", "absent"]) == ["y", "z"]
    assert folds.usable_targets(words, ["y", "z"], NormSpec(min_target_rows=10_000)) == []
    with pytest.raises(ValueError, match="usable rows"):
        benchmark.benchmark(words, "w", ["y"], spec=NormSpec(min_target_rows=10_000))


def test_baseline_predicts_the_other_folds_mean(words):
    pdf = words.toPandas()
    got = {r["outer_fold"]: r for r in metrics.baseline_metrics(words, ["y"]).collect()}
    for fold, held in pdf.groupby("outer_fold"):
        mean = pdf.loc[pdf.outer_fold != fold, "y"].mean()
        assert got[fold]["MAE"] == pytest.approx(np.round((held.y - mean).abs().mean(), 4), abs=1e-9)
        assert got[fold]["Pearson_r"] == 0.0


def ridge_fit(x, y, alpha):
    mx, my = x.mean(axis=0), y.mean()
    xc = x - mx
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ (y - my))
    return w, my - mx @ w


def corr(a, b):
    return 0.0 if a.std() == 0 or b.std() == 0 else np.corrcoef(a, b)[0, 1]


def nested(pdf, target, features, alphas):
    """Plain nested search; features(train, rows) gives the matrix of rows."""
    out = {}
    for outer in sorted(pdf.outer_fold.unique()):
        train, held = pdf[pdf.outer_fold != outer], pdf[pdf.outer_fold == outer]
        scores = np.zeros(len(alphas))
        for inner in (1, 2, 3):
            fit, val = train[train.inner_fold != inner], train[train.inner_fold == inner]
            x, v = features(fit, fit), features(fit, val)
            for k, a in enumerate(alphas):
                w, b = ridge_fit(x, fit[target].to_numpy(), a)
                scores[k] += corr(v @ w + b, val[target].to_numpy()) / 3
        best = int(np.argmax(scores))
        w, b = ridge_fit(features(train, train), train[target].to_numpy(), alphas[best])
        out[outer] = (alphas[best], held, features(train, held) @ w + b)
    return out


def test_ngram_ridge_stops_loudly_when_unsolved(words):
    with pytest.raises(ArithmeticError, match="unsolved after 1 passes"):
        ngram_ridge.ngram_predictions(words, "w", "w", ["y"], NormSpec(solver_passes=1))


def test_default_tolerance_changes_no_metric(words):
    exact = ngram_ridge.ngram_cv(words, "w", "w", ["y"], NormSpec(solver_tolerance=1e-10)).toPandas()
    usual = ngram_ridge.ngram_cv(words, "w", "w", ["y"]).toPandas()
    both = exact.merge(usual, on=["target", "outer_fold"], suffixes=("", "_d"))
    assert len(both) == 5 and (both.alpha == both.alpha_d).all()
    for c in ("MAE", "RMSE", "Pearson_r"):
        assert np.allclose(both[c], both[f"{c}_d"], atol=2e-3)


def test_ngram_ridge_equals_plain_nested_search(words):
    spec = NormSpec(solver_tolerance=1e-10)
    got = ngram_ridge.ngram_predictions(words, "w", "w", ["y", "z"], spec).toPandas()
    for target in ("y", "z"):
        pdf = words.toPandas().dropna(subset=[target])
        want = nested(pdf, target, lambda fit, rows: dense_tfidf(list(fit.w), list(rows.w))[0], spec.ridge_alphas)
        mine = got[got.target == target].set_index("key")
        assert len(mine) == len(pdf)
        for alpha, held, predicted in want.values():
            assert np.allclose(mine.loc[held.w, "prediction"], predicted, atol=1e-5)
            assert set(mine.loc[held.w, "alpha"]) == {alpha}


def test_dense_ridge_equals_plain_nested_search(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 6))
    y = x @ rng.normal(size=6) + rng.normal(size=400) + 3
    rows = [(i, [float(v) for v in x[i]], None if i % 17 == 0 else float(y[i])) for i in range(400)]
    df = folds.assign_folds(spark.createDataFrame(rows, "id int, emb array<float>, y double"), ["id"]).repartition(6)
    spec = NormSpec()
    got = ridge.dense_predictions(df, "emb", "y", 6, spec).toPandas().set_index("id")
    models = {r["outer_fold"]: r["alpha"] for r in ridge.dense_models(df, "emb", "y", 6, spec).collect()}
    pdf = df.toPandas().dropna(subset=["y"])
    assert len(got) == len(pdf)
    want = nested(pdf, "y", lambda fit, rows_: np.stack(rows_.emb.to_numpy()).astype("float64"), spec.ridge_alphas)
    for outer, (alpha, held, predicted) in want.items():
        assert models[outer] == alpha
        assert np.allclose(got.loc[held.id, "prediction"], predicted, atol=1e-8)


def test_benchmark_rows(words, spark):
    emb = words.withColumn("emb", F.array(F.length("w").cast("float"), F.lit(1.0).cast("float")))
    table = benchmark.benchmark(emb, "w", ["y", "z"], vectors={"Static vectors": ("emb", 2), "Missing": ("nope", 2)})
    rows = {(r["Target"], r["Representation"]): r for r in table.collect()}
    assert set(rows) == {(t, f) for t in "yz" for f in ("Dummy (mean predictor)", "Static vectors")}
    assert rows["y", "Static vectors"]["RMSE_mean"] < rows["y", "Dummy (mean predictor)"]["RMSE_mean"]


def test_vector_text_round_trip_and_first_duplicate(spark, tmp_path):
    path = tmp_path / "words.vec"
    path.write_text("4 3\nhuis 1 2 3\nboom 0.5 -1 1e-3\nhuis 9 9 9\nzee 0 0 0\n")
    got = {r["word"]: list(r["emb"]) for r in read_vector_text(spark, str(path)).collect()}
    assert got == {"huis": [1, 2, 3], "boom": pytest.approx([0.5, -1, 1e-3]), "zee": [0, 0, 0]}
    one = tmp_path / "one.vec"
    one.write_text("2 1\n7 1.5\nb 2\n")
    assert {r["word"] for r in read_vector_text(spark, str(one)).collect()} == {"7", "b"}
    (tmp_path / "bad.vec").write_text("huis 1 2 3\n")
    with pytest.raises(ValueError, match="header"):
        read_vector_text(spark, str(tmp_path / "bad.vec"))
    with pytest.raises(FileNotFoundError):
        read_vector_text(spark, str(tmp_path / "absent.vec"))
    back = str(tmp_path / "out")
    write_vector_text(read_vector_text(spark, str(path)), back)
    assert {r["word"]: list(r["emb"]) for r in read_vector_text(spark, back).collect()} == got


def test_lookup_strategies(spark, monkeypatch):
    table = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "word string, emb array<float>")
    asked = spark.createDataFrame([("a",), ("x",), ("a",), (None,)], "word string")
    for limit in (10, 1):
        monkeypatch.setattr(vectors, "WORD_LIST_LIMIT", limit)
        rows = vectors.lookup(asked, table, "word", 2).collect()
        assert len(rows) == 4 and sum(r["oov"] for r in rows) == 2
        assert all(list(r["emb"]) == ([0, 0] if r["oov"] else [1, 2]) for r in rows)
    noise = [tuple(r["emb"]) for r in vectors.lookup(asked.repartition(3), table, "word", 2, "random")
             .where("word = 'x'").collect()]
    again = [tuple(r["emb"]) for r in vectors.lookup(asked, table, "word", 2, "random").where("word = 'x'").collect()]
    assert noise == again and 0 < abs(noise[0][0]) < 0.1
    assert vectors.oov_rate(asked, table, "word").first() == (4, 2, 0.5)
    with pytest.raises(ValueError):
        vectors.lookup(asked, table, "word", 2, "other")


def test_random_vectors_have_the_asked_spread(spark):
    rows = spark.range(400).select(vectors.random_vector(F.col("id"), 20, 42).alias("v"))
    values = np.array([r["v"] for r in rows.collect()])
    assert abs(values.mean()) < 5e-4 and values.std() == pytest.approx(0.01, rel=0.05)


def test_masked_pool_and_alignment(spark):
    tokens = spark.createDataFrame(
        [("a", [1.0, 2.0], 1), ("a", [3.0, 6.0], 1), ("a", [99.0, 99.0], 0), ("b", [5.0, 5.0], 0)],
        "word string, emb array<float>, mask int")
    got = {r["word"]: (r["n_tokens"], list(r["emb"])) for r in vectors.masked_mean_pool(tokens, "word").collect()}
    assert got == {"a": (2, [2.0, 4.0]), "b": (0, [0.0, 0.0])}
    table = spark.createDataFrame([("a",), ("c",)], "word string")
    assert vectors.alignment(table, tokens, "word").first() == (1, 1, 2)
    with pytest.raises(ValueError, match="do not match"):
        vectors.require_alignment(table, tokens, "word")
    vectors.require_alignment(table, table, "word")
    assert vectors.shape(tokens).first() == (4, 2, 2)
    assert vectors.widen(tokens, "word", 2).columns == ["word", "0", "1"]


def test_norm_sources(spark, tmp_path):
    names = [f.name for f in tables.NORM_SCHEMA]
    csv = tmp_path / "norms.csv"
    csv.write_text(",".join(names) + "\n" + "NA," + ",".join(["2.5"] * 12) + ",N,2,1.0,0.5\n"
                   + "null,NaN," + ",".join([""] * 11) + ",,4,,\n")
    rows = {r["Word"]: r for r in tables.read_norms(spark, str(csv), "csv").collect()}
    assert set(rows) == {"NA", "null"}
    assert rows["null"]["Valence"] is None and rows["null"]["PoS"] is None and rows["NA"]["Length"] == 2
    path = str(tmp_path / "processed")
    frame = spark.createDataFrame([("a", float("nan")), ("b", 1.0)], "Word string, x double")
    tables.write_processed(frame, path)
    assert tables.read_processed(spark, path).where("x IS NULL").count() == 1
    renamed = tables.read_norms(spark, path, rename={"x": "Valence"})
    assert renamed.columns == ["Word", "Valence"]
    with pytest.raises(FileNotFoundError):
        tables.read_norms(spark, str(tmp_path / "absent"))
    tables.write_report(frame, str(tmp_path / "report"))
    files = list((tmp_path / "report").glob("*.csv"))
    assert len(files) == 1 and files[0].read_text().splitlines()[0] == "Word,x"


def test_cached_table_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("a", [1.0])], "word string, emb array<float>")

    path = str(tmp_path / "cache")
    assert tables.cached_table(spark, path, build).count() == tables.cached_table(spark, path, build).count() == 1
    assert calls == [1]
    assert read_vector_cache(spark, str(tmp_path / "none")) is None
    write_vector_cache(build(), str(tmp_path / "vc"))
    assert read_vector_cache(spark, str(tmp_path / "vc")).columns == ["word", "emb"]
