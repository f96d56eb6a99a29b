"""Every registered query: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlens import spec as S
from normlens.functions.hashing import fold_of, key_text
from normlens.functions.numeric import round_even, row_mean
from normlens.operators import (
    audit, bands, benchmark, correlate, density, describe, folds, metrics, ngram_ridge, ngrams, ranking,
    ridge, robustness, sketches, subgroups, targets, topk, vectors)
from normlens.functions.text import char_ngrams
from normlens.plans import views
from normlens.plans.relational import materialize, shared_folder
from normlens.plans.views import ROW_KEY
from normlens.sources.tables import compute_or_reuse
from normlens.sources.vectors import read_vector_text, write_bucketed_vectors, write_vector_text
from normlens.spec import DEFAULT_SPEC, PRIMARY_BAND

Query = Callable[[SparkSession, str], DataFrame]
NORM_COLUMNS = ["Word", *S.RATING_COLUMNS, "Frequency_Zipf", "Concreteness", "Imageability", "PoS"]
SCATTER_PAIRS = (("Valence", "PositiveAffect"), ("Valence", "NegativeAffect"),
                 ("PositiveAffect", "NegativeAffect"), ("Ambivalence_product", "Ambivalence_min"))


def on_norms(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: build(views.ratings(spark, sf))


def on_processed(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: build(targets.add_targets(views.ratings(spark, sf)))


def _rounded(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: round_even(c, digits) for c in cols})


def _row_mean(df: DataFrame) -> DataFrame:
    out = df.select(
        *ROW_KEY,
        row_mean(["Happiness"]).alias("positive"),
        row_mean(["Anger", "Fear", "Sadness", "Disgust"]).alias("negative"),
        row_mean(["Anger", "Fear", "Sadness", "Disgust", "Surprise"]).alias("negative_with_surprise"),
        row_mean(["Sadness"]).alias("sadness_only"))
    return _rounded(out, ["positive", "negative", "negative_with_surprise", "sadness_only"])


def _minmax(df: DataFrame) -> DataFrame:
    out = targets.minmax_scale(targets.add_affect_means(df), ["PositiveAffect", "NegativeAffect"])
    cols = ["PositiveAffect_01", "NegativeAffect_01"]
    return _rounded(out.select(*ROW_KEY, *cols), cols)


def _zscore(df: DataFrame) -> DataFrame:
    out = targets.zscore(targets.add_affect_means(df), ["PositiveAffect", "NegativeAffect", "Sadness"])
    cols = ["PositiveAffect_z", "NegativeAffect_z", "Sadness_z"]
    return _rounded(out.select(*ROW_KEY, *cols), cols)


def _ambivalence(df: DataFrame) -> DataFrame:
    return df.select(*ROW_KEY, "PositiveAffect_01", "NegativeAffect_01",
                     "Ambivalence_product", "Ambivalence_min")


def _by_fold(df: DataFrame) -> DataFrame:
    folds = DEFAULT_SPEC.outer_folds
    scored = targets.add_affect_means(df).withColumn(
        "fold", fold_of(DEFAULT_SPEC.seed, key_text(ROW_KEY[:-1]), folds))
    out = targets.minmax_scale_by_fold(scored, "NegativeAffect", "fold", folds)
    return _rounded(out.select(*ROW_KEY, "fold", "train_min", "train_max", "NegativeAffect_01"),
                    ["train_min", "train_max", "NegativeAffect_01"])


NORM_QUERIES: dict[str, Query] = {
    "audit_columns": on_norms(audit.column_presence),
    "audit_profile": on_norms(lambda d: audit.column_profile(d.select(*NORM_COLUMNS))),
    "audit_out_of_range": on_norms(lambda d: audit.out_of_range_counts(
        d.withColumn("Arousal", F.col("Arousal") * 1.25))),
    "audit_summary": on_norms(lambda d: audit.dataset_summary(d.select(*NORM_COLUMNS))),
    # Items of quantity 1 and 2 are planted twice, as no full row repeats by itself.
    "audit_duplicate_rows": on_norms(lambda d: audit.duplicate_rows(d.unionByName(d.where("Concreteness < 3")))),
    "audit_duplicate_keys": on_norms(audit.duplicate_keys),
    "row_mean": on_norms(_row_mean),
    "minmax_scale": on_norms(_minmax),
    "rescale_params": on_norms(lambda d: targets.rescale_params(targets.add_affect_means(d))),
    "zscore": on_norms(_zscore),
    "ambivalence": on_processed(_ambivalence),
    "word_length": on_norms(lambda d: targets.add_word_length(d).select(*ROW_KEY, "Word", "Length")),
    "band_filter": on_norms(lambda d: bands.band_filter(d, PRIMARY_BAND).select(*ROW_KEY, "Word", "Valence")),
    "descriptives": on_processed(describe.descriptives),
    "derived_describe": on_processed(describe.describe),
    "quantiles": on_norms(lambda d: _rounded(ranking.quantile_table(
        d, ["Valence", "Arousal", "Sadness", "Imageability"], [0.05, 0.25, 0.5, 0.75, 0.95]), ["value"])),
    "approx_quantiles": on_norms(lambda d: sketches.quantile_check(
        d, ["Valence", "Arousal", "Sadness", "Imageability"], [0.05, 0.25, 0.5, 0.75, 0.95])),
    "cached_describe": lambda spark, sf: _cached_describe(spark, sf),
    "band_summary": on_processed(bands.band_summary),
    "band_sensitivity": on_processed(bands.band_sensitivity),
    "histogram": on_processed(density.histogram),
    "histogram_paired": on_processed(lambda d: density.histogram(d, S.SIDE_BY_SIDE_VARIABLES, DEFAULT_SPEC.paired_bins)),
    "kde_curve": on_processed(density.kde_curve),
    "kde_binned": on_processed(lambda d: _rounded(density.kde_binned(d, tolerance=1e-7).drop("error_bound"), ["density"], 4)),
    "pearson_matrix": on_processed(correlate.pearson_matrix),
    "spearman_matrix": on_processed(correlate.spearman_matrix),
    "corr_lower_triangle": on_processed(lambda d: correlate.lower_triangle(correlate.pearson_matrix(d))),
    "construct_checks": on_processed(correlate.construct_checks),
    "scatter_corr": on_processed(lambda d: correlate.scatter_corr(d, SCATTER_PAIRS, ROW_KEY)),
    "top_k": on_processed(lambda d: topk.top_k(d, "Ambivalence_product", ROW_KEY)
                          .withColumn("NegativeAffect", round_even("NegativeAffect", 6))),
    "exemplars": on_processed(lambda d: _rounded(topk.exemplars(d, ROW_KEY), [
        "Valence", "PositiveAffect", "NegativeAffect"])),
    "seeded_sample": on_processed(lambda d: topk.seeded_sample(
        d.select(*ROW_KEY, "Valence", "Ambivalence_product"), ROW_KEY, DEFAULT_SPEC.band_plot_rows,
        drop_null=("Valence", "Ambivalence_product"), band_col="Valence")),
    "seeded_sample_first": on_processed(lambda d: topk.seeded_sample(
        d.select(*ROW_KEY, "Valence", "Sadness"), ROW_KEY, DEFAULT_SPEC.band_plot_rows, drop_null=("Valence", "Sadness"),
        band_col="Valence", sample_first=True)),
    "median_split": on_norms(lambda d: _rounded(
        subgroups.median_split(d, "Imageability", ROW_KEY), ["cutoff"])),
    "subgroup_coverage": on_processed(subgroups.subgroup_coverage),
    "small_subgroups": on_processed(lambda d: subgroups.small_subgroups(subgroups.subgroup_coverage(
        d.withColumn("PoS", F.concat_ws("-", "PoS", "l_suppkey", "l_linenumber"))))),
    "formula_comparison": on_processed(robustness.formula_comparison),
    "band_sensitivity_ge": on_processed(bands.band_sensitivity_inclusive),
    "source_sensitivity": on_processed(robustness.source_sensitivity),
    "scaling_sensitivity": on_processed(robustness.scaling_sensitivity),
    "robustness_summary": on_processed(robustness.robustness_summary),
    "minmax_scale_by_fold": on_norms(_by_fold),
}


def on_lexicon(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: build(views.lexicon(spark, sf))


def on_modelling(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: build(folds.assign_folds(views.modelling_lexicon(spark, sf), ["w"]))


def on_vectors(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: build(views.vectors(spark, sf))


def _char_ngrams(df: DataFrame) -> DataFrame:
    grams = df.select("w", char_ngrams("w", DEFAULT_SPEC.ngram_range).alias("g"))
    return grams.select("w", F.size("g").alias("n_grams"), F.array_join("g", "|").alias("grams"))


def _fold_fit(df: DataFrame) -> DataFrame:
    words = folds.assign_folds(df.select("w"), ["w"])
    terms = ngrams.term_counts(words, "w", "w", keep=("outer_fold", "inner_fold"))
    return _rounded(ngrams.fold_vocabularies(terms, words), ["idf"])


def _word_metrics(df: DataFrame) -> DataFrame:
    return metrics.fold_metrics(df, "pos", "en_share")


def _known(df: DataFrame) -> DataFrame:
    return df.where("label <> 9").select("vec_id", "emb")


def _lookup(df: DataFrame) -> DataFrame:
    found = vectors.lookup(df.select("vec_id"), _known(df), "vec_id", vectors.dimension(df))
    return vectors.explode_vector(found, ["vec_id", "oov"])


def _pooled(spark: SparkSession, sf: str) -> DataFrame:
    pooled = vectors.masked_mean_pool(views.token_vectors(spark, sf), "word_id")
    return _rounded(vectors.explode_vector(pooled, ["word_id", "n_tokens"]), ["value"])


def _misaligned(df: DataFrame) -> DataFrame:
    stored = _known(df).unionByName(df.where("label = 0").select("vec_id", "emb"))
    return vectors.alignment(df.where("label <> 8").select("vec_id"), stored, "vec_id")


def _regression_rows(df: DataFrame) -> DataFrame:
    return folds.assign_folds(df.select("vec_id", "emb", F.col("label").cast("double").alias("y")), ["vec_id"])


def _dense_cv(df: DataFrame) -> DataFrame:
    return ridge.dense_cv(_regression_rows(df), "emb", "y", vectors.dimension(df))


def _alpha_search(df: DataFrame) -> DataFrame:
    rows = _regression_rows(df)
    return _rounded(ridge.alpha_scores(ridge.dense_models(rows, "emb", "y", vectors.dimension(df))), ["inner_r"])


def _oof(df: DataFrame) -> DataFrame:
    rows = _regression_rows(df)
    return _rounded(ridge.dense_predictions(rows, "emb", "y", vectors.dimension(df))
                    .select("vec_id", "outer_fold", "y", "prediction"), ["prediction"])


def _vector_text(spark: SparkSession, sf: str) -> DataFrame:
    """Write the embeddings as vector text in the shared folder and scan them back."""
    path = f"{shared_folder(spark)}/vector-text-{uuid.uuid4().hex}"
    write_vector_text(views.vectors(spark, sf), path, key="vec_id")
    return vectors.explode_vector(read_vector_text(spark, path), ["word"])


def _lookup_random(df: DataFrame) -> DataFrame:
    found = vectors.lookup(df.select("vec_id"), _known(df), "vec_id", vectors.dimension(df), unknown="random")
    return _rounded(vectors.explode_vector(found.where("oov"), ["vec_id", "oov"]).withColumn(
        "value", F.col("value").cast("double")), ["value"], 5)


def _lookup_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """Store the known vectors in buckets in the shared folder and look all words up."""
    items, name = views.vectors(spark, sf), f"vectors_{uuid.uuid4().hex}"
    stored = write_bucketed_vectors(_known(items), name, f"{shared_folder(spark)}/{name}", "vec_id",
                                    max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = vectors.lookup_bucketed(items.select("vec_id"), stored, "vec_id", vectors.dimension(items))
    return vectors.explode_vector(found, ["vec_id", "oov"])


def _cached_describe(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptives computed once for these settings and input files, and read again from the cache."""
    path, source = f"{shared_folder(spark)}/describe-cache-{uuid.uuid4().hex}", views.ratings(spark, sf)

    def build() -> DataFrame:
        return describe.describe(targets.add_targets(source))

    def ask() -> DataFrame:
        return compute_or_reuse(spark, path, build, {"step": "describe", "spec": DEFAULT_SPEC}, [source])
    ask()
    return ask()


def _benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """Every target of the lexicon against the mean, n-grams and static vectors of the same words."""
    words, dim = views.modelling_vectors(spark, sf)
    rows = materialize(folds.assign_folds(words, ["w"]))
    return benchmark.benchmark(rows, "w", views.LEXICON_TARGETS, text="w", vectors={"Static vectors": ("emb", dim)})


LEXICON_QUERIES: dict[str, Query] = {
    "char_ngrams": on_lexicon(_char_ngrams),
    "ngram_vocab": on_lexicon(lambda d: ngrams.vocabulary(ngrams.term_counts(d, "w", "w"))),
    "tfidf": on_lexicon(lambda d: _rounded(ngrams.tfidf(d, "w", "w"), ["weight"])),
    "tfidf_fold_fit": on_lexicon(_fold_fit),
    "feature_report": on_lexicon(lambda d: ngrams.feature_report(d, "w", "w")),
    "cv_folds": on_lexicon(lambda d: folds.assign_folds(d.select("w"), ["w"])),
    "target_gate": on_lexicon(lambda d: folds.target_gate(d, ("en_share", "pos", "neg"))),
    "dummy_baseline": on_modelling(lambda d: metrics.dummy_baseline(d, views.LEXICON_TARGETS)),
    "fold_metrics": on_modelling(_word_metrics),
    "cv_summary": on_modelling(lambda d: metrics.cv_summary(_word_metrics(d))),
    "ridge_cv_ngrams": on_modelling(lambda d: ngram_ridge.ngram_cv(d, "w", "w", views.LEXICON_TARGETS)),
    "cv_folds_balanced": on_lexicon(lambda d: folds.assign_balanced_folds(d.select("w"), ["w"])),
}
VECTOR_QUERIES: dict[str, Query] = {
    "embedding_wide": on_vectors(lambda d: vectors.widen(d, "vec_id", vectors.dimension(d))),
    "embedding_lookup": on_vectors(_lookup),
    "embedding_lookup_random": on_vectors(_lookup_random),
    "embedding_lookup_bucketed": _lookup_bucketed,
    "oov_rate": on_vectors(lambda d: vectors.oov_rate(d.select("vec_id"), _known(d), "vec_id")),
    "masked_mean_pool": _pooled,
    "embedding_alignment": on_vectors(_misaligned),
    "embedding_shape": on_vectors(vectors.shape),
    "ridge_cv_embeddings": on_vectors(_dense_cv),
    "alpha_search": on_vectors(_alpha_search),
    "oof_predictions": on_vectors(_oof),
    "vec_text_scan": _vector_text,
    "benchmark_results": _benchmark,
}
QUERIES: dict[str, Query] = {**NORM_QUERIES, **LEXICON_QUERIES, **VECTOR_QUERIES}
