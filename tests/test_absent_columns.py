"""Checks degrade where a column is absent instead of failing as a whole."""

import pytest

from normlens.operators import bands, robustness

COLUMNS = ("Valence", "PositiveAffect", "NegativeAffect", "Ambivalence_product", "Ambivalence_min")


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(1 + i % 5 * 1.0, i % 7 / 7, i % 3 / 3, round(i % 7 / 7 * (i % 3) / 3, 6), round(min(i % 7 / 7, i % 3 / 3), 6)) for i in range(60)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in COLUMNS))


@pytest.mark.parametrize("gone", COLUMNS)
def test_summary_keeps_the_other_checks(scored, gone):
    rows = robustness.robustness_summary(scored.drop(gone)).collect()
    skipped = [r.check for r in rows if "status" in r and r.status.startswith("SKIPPED")]
    want = {"Valence": ["Threshold sensitivity"], "PositiveAffect": ["Scaling sensitivity"], "NegativeAffect": ["Scaling sensitivity"],
            "Ambivalence_product": ["Ambivalence formula"], "Ambivalence_min": ["Ambivalence formula"]}[gone]
    assert skipped == want and len(rows) == (3 if gone == "Valence" else 5)


def test_band_summary_without_scores_or_valence(scored):
    row = bands.band_summary(scored.drop("Ambivalence_min")).first()
    assert row.mean_Ambivalence_min is None and row.pct_high_ambivalence_min is None
    assert row.mean_Ambivalence_product is not None and row.n_near_neutral == 12
    assert bands.band_summary(scored.select("Valence")).first().n_near_neutral == 12
    assert bands.band_summary(scored.drop("Valence")).first().error == "'Valence' column missing"
    assert bands.band_sensitivity(scored.drop("Valence")).count() == 3
