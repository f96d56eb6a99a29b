"""Column names, bands, thresholds and model settings, all overridable.

Every operator takes the part of the spec it needs as an argument whose default
comes from ``DEFAULT_SPEC``; nothing else in the package hard-codes a setting.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values -----------------------------------------------------------
# Column names, band limits, labels and settings that results must carry
# unchanged.

COLUMN_ALIASES = {
    "word": "Word",
    "valence": "Valence",
    "arousal": "Arousal",
    "happiness": "Happiness",
    "anger": "Anger",
    "fear": "Fear",
    "sadness": "Sadness",
    "disgust": "Disgust",
    "surprise": "Surprise",
    "positive_affect": "PositiveAffect",
    "negative_affect": "NegativeAffect",
    "ambivalence_prod": "Ambivalence_product",
    "ambivalence_min": "Ambivalence_min",
    "frequency": "Frequency_Zipf",
    "concreteness": "Concreteness",
    "imageability": "Imageability",
    "aoa": "AoA",
    "pos": "PoS",
    "length": "Length",
    "rt": "DLP_RT",
    "accuracy": "DLP_Acc",
}

RATING_COLUMNS = (
    "Valence", "Arousal", "Happiness", "Anger",
    "Fear", "Sadness", "Disgust", "Surprise",
)
DERIVED_TARGETS = (
    "PositiveAffect", "NegativeAffect", "Ambivalence_product", "Ambivalence_min",
)
STAT_VARIABLES = RATING_COLUMNS + DERIVED_TARGETS
SIDE_BY_SIDE_VARIABLES = (
    "Valence", "PositiveAffect", "NegativeAffect",
    "Ambivalence_product", "Ambivalence_min",
)

RESCALE_NOTE = "fit on full dataset (exploratory phase only)"
NEAR_NEUTRAL_VARIABLE = "Near-neutral (Valence)"
POS_VARIABLE = "Part of Speech (POS)"
EXEMPLAR_CATEGORIES = (
    "Near-neutral, Low Ambivalence",
    "Near-neutral, High Ambivalence",
    "High PositiveAffect, Low NegativeAffect",
    "Low Valence, High NegativeAffect",
)
CONSTRUCT_QUESTIONS = (
    ("How strongly does PositiveAffect track Valence?", "PositiveAffect", "Valence"),
    ("How strongly does NegativeAffect track Valence?", "NegativeAffect", "Valence"),
    ("Are the two ambivalence formulas highly similar?", "Ambivalence_product", "Ambivalence_min"),
    ("Does unipolar-style representation provide info beyond bipolar Valence?",
     "Ambivalence_product", "Valence"),
)
STRENGTH_CUTS = ((0.7, "Strong"), (0.4, "Moderate"), (0.2, "Weak"))
STRENGTH_FLOOR = "Negligible"
STRENGTH_MISSING = "N/A (column missing)"
VERDICT_SIMILAR = "Formulas are HIGHLY SIMILAR (r≥0.90); both can be reported as converging."
VERDICT_DIVERGE = (
    "Formulas DIVERGE meaningfully; Ambivalence_min is more conservative. "
    "Report both and note the difference in thesis limitations."
)
VERDICT_SCALING_ROBUST = "Ambivalence scores are ROBUST to scaling choice (r≥0.95)."
VERDICT_SCALING_EFFECT = "Scaling choice has MATERIAL EFFECT on ambivalence; discuss in methods."
VERDICT_BAND_ROBUST = "ROBUST"
VERDICT_BAND_SENSITIVE = "THRESHOLD-SENSITIVE"
NOT_AVAILABLE = "N/A"
SKIPPED_FORMULA = ("Ambivalence formula", "SKIPPED - column missing")
SKIPPED_BANDS = ("Threshold sensitivity", "SKIPPED - Valence missing")
SKIPPED_SCALING = ("Scaling sensitivity", "SKIPPED - columns missing")
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Band:
    """Closed interval [lo, hi] on the valence scale."""

    label: str
    lo: float
    hi: float

    @property
    def text(self) -> str:
        return f"[{self.lo}, {self.hi}]"


PRIMARY_BAND = Band("Primary [2.75, 3.25]", 2.75, 3.25)
NARROW_BAND = Band("Narrow  [2.90, 3.10]", 2.90, 3.10)
WIDE_BAND = Band("Wide    [2.50, 3.50]", 2.50, 3.50)


@dataclass(frozen=True)
class NormSpec:
    columns: dict[str, str] = field(default_factory=lambda: dict(COLUMN_ALIASES))
    positive_sources: tuple[str, ...] = ("Happiness",)
    negative_sources: tuple[str, ...] = ("Anger", "Fear", "Sadness", "Disgust")
    exploratory_source: str = "Surprise"
    rescale_range: tuple[float, float] = (0.0, 1.0)
    scale: tuple[float, float] = (1.0, 5.0)
    bands: tuple[Band, ...] = (PRIMARY_BAND, NARROW_BAND, WIDE_BAND)
    high_quantile: float = 0.75
    spread_tolerance: float = 5.0
    min_group_rows: int = 50
    seed: int = 42
    outer_folds: int = 5
    inner_folds: int = 3
    min_target_rows: int = 100
    ridge_alphas: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
    ngram_range: tuple[int, int] = (2, 4)
    min_df: int = 3
    max_features: int = 50_000
    solver_tolerance: float = 1e-4
    solver_passes: int = 1000
    grid_bins: int = 50
    paired_bins: int = 40
    kde_points: int = 300
    scatter_rows: int = 5_000
    band_plot_rows: int = 6_000
    top_rows: int = 20
    exemplar_rows: int = 10

    @property
    def primary_band(self) -> Band:
        return self.bands[0]


DEFAULT_SPEC = NormSpec()
