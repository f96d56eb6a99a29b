import pytest
from pyspark.sql import functions as F

from normlens import spec as S
from normlens.operators import audit, bands, describe, robustness, subgroups, targets, topk
from normlens.operators.correlate import construct_checks
from normlens.spec import Band, NormSpec

SCHEMA = ("id int, Word string, Valence double, Happiness double, Anger double, Fear double, Sadness double, "
          "Disgust double, Surprise double, PoS string")


@pytest.fixture(scope="module")
def norms(spark):
    rows = []
    for i in range(200):
        rows.append((i, f"w{i % 190}", 1 + 4 * (i % 41) / 40, 1 + 4 * (i * 7 % 31) / 30, 1 + 4 * (i * 3 % 29) / 28,
                     1 + 4 * (i * 5 % 23) / 22, None if i % 9 == 0 else 1 + 4 * (i % 11) / 10,
                     1 + 4 * (i % 13) / 12, 3.0, None if i % 5 == 0 else "NVA"[i % 3]))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def processed(norms):
    return targets.add_targets(norms).cache()


def test_targets_required_columns(norms):
    with pytest.raises(KeyError, match="Fear"):
        targets.add_targets(norms.drop("Fear"))


def test_zero_range_is_an_error(norms):
    flat = norms.withColumn("Happiness", F.lit(2.0))
    with pytest.raises(Exception, match="zero range"):
        targets.add_targets(flat).collect()
    lenient = targets.minmax_scale(flat, ["Happiness"], strict=False)
    assert lenient.where("Happiness_01 IS NOT NULL").count() == 0


def test_scaled_scores_are_consistent(processed):
    bad = processed.where(
        "PositiveAffect_01 NOT BETWEEN 0 AND 1 OR NegativeAffect_01 NOT BETWEEN 0 AND 1 "
        "OR Ambivalence_product > Ambivalence_min + 1e-6")
    assert bad.count() == 0
    assert processed.agg(F.min("PositiveAffect_01"), F.max("PositiveAffect_01")).first() == (0.0, 1.0)


def test_product_propagates_null_and_minimum_skips_it(spark):
    rows = [(1.0, 1.0), (5.0, 5.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "Happiness double, Anger double")
    out = targets.add_targets(df, NormSpec(negative_sources=("Anger",))).where("Happiness IS NULL").first()
    assert out["Ambivalence_product"] is None and out["Ambivalence_min"] == 0.5


def test_rescale_range_is_a_parameter(norms):
    wide = targets.add_targets(norms, NormSpec(rescale_range=(-1.0, 1.0)))
    assert wide.agg(F.min("PositiveAffect_01")).first()[0] == -1.0


def test_length_is_added_only_when_absent(norms):
    assert targets.add_word_length(norms).where("Length <> length(Word)").count() == 0
    given = norms.withColumn("Length", F.lit(99))
    assert targets.add_word_length(given).where("Length <> 99").count() == 0


def test_training_range_excludes_own_fold(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 100.0), (2, 10.0), (2, 20.0), (3, 15.0)], "fold int, x double")
    out = {(r["fold"], r["x"]): (r["train_min"], r["train_max"], r["x_01"])
           for r in targets.minmax_scale_by_fold(df, "x", "fold", 3).collect()}
    assert out[(1, 100.0)] == (10.0, 20.0, 9.0)
    assert out[(2, 10.0)] == (0.0, 100.0, 0.1)


def test_audit_counts_planted_problems(spark):
    rows = [("a", 6.0), ("a", 6.0), (None, 2.0), (None, 2.0), (None, 3.0), ("b", 0.5), ("c", None)]
    df = spark.createDataFrame(rows, "Word string, Valence double")
    assert audit.duplicate_rows(df).first()[0] == 2
    assert audit.duplicate_keys(df).first()[0] == 3
    assert audit.duplicate_keys(df.drop("Word")).first()[0] is None
    assert audit.out_of_range_counts(df).first()["n_out_of_range"] == 3
    profile = {r["Column"]: r for r in audit.column_profile(df).collect()}
    assert profile["Word"]["min"] is None and profile["Word"]["N_missing"] == 3
    assert profile["Valence"]["N_out_of_range_1_5"] == 3 and profile["Valence"]["Pct_missing"] == 14.29
    presence = {r["alias"]: r["present"] for r in audit.column_presence(df).collect()}
    assert presence["word"] and not presence["arousal"]
    assert audit.dataset_summary(df).first()["out_of_range"]


def test_band_rows_nest_and_empty_bands_stay(processed):
    n = {r["threshold_label"].split()[0]: r["n_near_neutral"] for r in bands.band_sensitivity(processed).collect()}
    assert n["Narrow"] <= n["Primary"] <= n["Wide"]
    row = bands.band_summary(processed, Band("none", 7.0, 8.0)).first()
    assert row["n_near_neutral"] == 0 and row["mean_PositiveAffect"] is None
    assert row["pct_high_ambivalence_product"] is None and row["pct_of_total"] == 0.0


def test_band_verdict_switches(processed):
    far = [Band("low", 1.0, 1.2), Band("mid", 2.0, 4.0)]
    strict = NormSpec(spread_tolerance=0.0)
    assert {r["verdict"] for r in bands.band_sensitivity(processed, far, strict).collect()} == {
        S.VERDICT_BAND_SENSITIVE}


def test_results_do_not_depend_on_partitioning(norms):
    def table(df):
        return sorted(map(repr, bands.band_sensitivity(targets.add_targets(df)).collect()))
    assert table(norms.repartition(1)) == table(norms.repartition(7).orderBy("Fear"))


def test_descriptives_skip_absent_variables(norms):
    rows = describe.descriptives(norms).collect()
    assert {r["Variable"] for r in rows} == set(S.RATING_COLUMNS) - {"Arousal"}
    flat = next(r for r in rows if r["Variable"] == "Surprise")
    assert flat["SD"] == 0.0 and flat["Skewness"] is None and flat["IQR"] == 0.0


def test_subgroups_add_up_and_mark_absent_columns(processed):
    rows = subgroups.subgroup_coverage(processed).collect()
    skipped = {r["Variable"] for r in rows if r["Subgroup"] == "SKIPPED"}
    assert skipped == {"Frequency", "Concreteness", "Imageability"}
    for variable in {r["Variable"] for r in rows} - skipped:
        mine = [r for r in rows if r["Variable"] == variable]
        assert sum(r["N"] for r in mine) + mine[0]["N_missing_in_var"] == 200
    assert {r["Subgroup"] for r in rows if r["Variable"] == S.POS_VARIABLE} == {"N", "V", "A", "Unknown"}
    assert all(r["N"] < 50 for r in subgroups.small_subgroups(subgroups.subgroup_coverage(processed)).collect())


def test_median_split_keeps_null(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, None)], "id int, x double")
    got = {r["id"]: r["subgroup"] for r in subgroups.median_split(df, "x", ["id"]).collect()}
    assert got == {1: "Low", 2: "Low", 3: "High", 4: None}


def test_top_k_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 1.0), (4, None), (5, 0.5)], "id int, s double")
    assert [r["id"] for r in topk.top_k(df.repartition(4), "s", ["id"], n=2).collect()] == [1, 2]


def test_sample_is_exact_stable_and_whole(norms):
    a = {r["id"] for r in topk.seeded_sample(norms, ["id"], 50).collect()}
    b = {r["id"] for r in topk.seeded_sample(norms.repartition(9), ["id"], 50).collect()}
    assert a == b and len(a) == 50
    assert topk.seeded_sample(norms, ["id"], 10_000).count() == 200
    assert topk.seeded_sample(norms, ["id"], 500, drop_null=("Sadness",)).count() == norms.dropna(subset=["Sadness"]).count()


def test_sample_of_equal_keys_still_returns_n(spark):
    # One hash value for all rows: the cut-off keeps none or all, the size must hold.
    df = spark.range(20000).withColumn("k", F.lit(1))
    assert topk.seeded_sample(df, ["k"], 30).count() == 30


def test_exemplars_have_four_categories(processed):
    counts = {r["Category"]: r["count"] for r in topk.exemplars(processed, ["id"]).groupBy("Category").count().collect()}
    assert set(counts) <= set(S.EXEMPLAR_CATEGORIES) and max(counts.values()) <= 10


def test_construct_checks_with_absent_column(processed):
    rows = construct_checks(processed.drop("Ambivalence_min")).collect()
    gone = next(r for r in rows if r["Variable_B"] == "Ambivalence_min")
    assert gone["Pearson_r"] is None and gone["Strength"] == S.STRENGTH_MISSING and gone["Direction"] == "N/A"


def test_robustness_tables(processed):
    scaling = robustness.scaling_sensitivity(processed).first()
    assert scaling["Pearson_r_between"] >= 0.999999
    versions = robustness.source_sensitivity(processed.drop("Surprise")).collect()
    assert [r["mean_NegativeAffect"] is None for r in versions] == [False, True]
    summary = robustness.robustness_summary(processed).collect()
    assert len(summary) == 5 and all(None not in tuple(r) for r in summary)
