"""Independent DuckDB SQL for the registered queries."""

from __future__ import annotations

from normlens import spec as S

KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
VARS = S.STAT_VARIABLES

RATINGS = f"""ratings AS (
  SELECT {KEYS},
    concat(l_orderkey, '-', l_linenumber) AS "Word",
    1e0 + 4e0 * (l_quantity - 1e0) / 49e0 AS "Valence",
    1e0 + 4e0 * l_extendedprice / 105000e0 AS "Arousal",
    1e0 + 40e0 * l_discount AS "Happiness",
    1e0 + 50e0 * l_tax AS "Anger",
    5e0 - 4e0 * (l_quantity - 1e0) / 49e0 AS "Fear",
    CASE WHEN l_linenumber = 7 THEN NULL ELSE 1e0 + 4e0 * (l_linenumber - 1) / 6e0 END AS "Sadness",
    1e0 + 4e0 * (l_partkey % 50) / 49e0 AS "Disgust",
    1e0 + 4e0 * (l_suppkey % 10) / 9e0 AS "Surprise",
    l_extendedprice AS "Frequency_Zipf",
    l_quantity AS "Concreteness",
    CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_tax END AS "Imageability",
    nullif(l_returnflag, 'R') AS "PoS"
  FROM lineitem)"""

AFFECT = RATINGS + """,
affect AS (
  SELECT *, "Happiness" AS "PositiveAffect",
    ("Anger" + "Fear" + coalesce("Sadness", 0e0) + "Disgust")
      / (CASE WHEN "Sadness" IS NULL THEN 3e0 ELSE 4e0 END) AS "NegativeAffect"
  FROM ratings)"""


def r(expr: str, digits: int) -> str:
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits})"


TARGETS = AFFECT + f""",
lims AS (SELECT min("PositiveAffect") AS pl, max("PositiveAffect") AS ph,
                min("NegativeAffect") AS nl, max("NegativeAffect") AS nh FROM affect),
scaled AS (SELECT affect.*, ("PositiveAffect" - pl) / (ph - pl) AS pe,
                  ("NegativeAffect" - nl) / (nh - nl) AS ne FROM affect, lims),
processed AS (
  SELECT * EXCLUDE (pe, ne), {r('pe', 6)} AS "PositiveAffect_01", {r('ne', 6)} AS "NegativeAffect_01",
    {r('pe * ne', 6)} AS "Ambivalence_product",
    least({r('pe', 6)}, {r('ne', 6)}) AS "Ambivalence_min"
  FROM scaled)"""


def unpivot(source: str, cols: tuple[str, ...] | list[str], extra: str = "") -> str:
    """Long form with NULLs kept: name, idx, value."""
    return " UNION ALL ".join(
        f"SELECT {extra} '{c}' AS name, {i} AS idx, CAST(\"{c}\" AS DOUBLE) AS value FROM {source}"
        for i, c in enumerate(cols))


def _presence() -> str:
    have = {"Word", *S.RATING_COLUMNS, "Frequency_Zipf", "Concreteness", "Imageability", "PoS"}
    rows = [f"SELECT '{a}' AS alias, '{c}' AS \"column\", {str(c in have).lower()} AS present, "
            + (f'(SELECT count("{c}") FROM ratings)' if c in have else "CAST(0 AS BIGINT)") + " AS n_values"
            for a, c in S.COLUMN_ALIASES.items()]
    return f"WITH {RATINGS} " + " UNION ALL ".join(rows)


def _profile() -> str:
    cols = ["Word", *S.RATING_COLUMNS, "Frequency_Zipf", "Concreteness", "Imageability", "PoS"]
    rows = []
    for c in cols:
        text = c in ("Word", "PoS")
        stats = {"min": f'min("{c}")', "max": f'max("{c}")', "mean": f'avg("{c}")', "SD": f'stddev_samp("{c}")'}
        parts = [("CAST(NULL AS DOUBLE)" if text else r(e, 4)) + f' AS "{k}"' for k, e in stats.items()]
        out = (f'count(*) FILTER (WHERE "{c}" < 1 OR "{c}" > 5)' if c in S.RATING_COLUMNS
               else "CAST(NULL AS BIGINT)")
        rows.append(f"""SELECT '{c}' AS "Column", '{"string" if text else "double"}' AS dtype,
          count(*) - count("{c}") AS "N_missing",
          {r(f'(count(*) - count("{c}"))::DOUBLE / count(*) * 100e0', 2)} AS "Pct_missing",
          {', '.join(parts)}, {out} AS "N_out_of_range_1_5" FROM ratings""")
    return f"WITH {RATINGS} " + " UNION ALL ".join(rows)


def _out_of_range() -> str:
    rows = [f"SELECT '{c}' AS \"Column\", count(*) FILTER (WHERE v < 1 OR v > 5) AS n_out_of_range FROM "
            f"(SELECT \"{c}\"{' * 1.25e0' if c == 'Arousal' else ''} AS v FROM ratings)"
            for c in S.RATING_COLUMNS]
    return f"WITH {RATINGS} " + " UNION ALL ".join(rows)


def _summary() -> str:
    cols = ["Word", *S.RATING_COLUMNS, "Frequency_Zipf", "Concreteness", "Imageability", "PoS"]
    listed = ", ".join(f'"{c}"' for c in cols)
    rows = [f"""SELECT '{c}' AS "Column", count(*) AS n_rows, {len(cols)} AS n_columns,
        (SELECT count(*) FROM ratings) - (SELECT count(*) FROM (SELECT DISTINCT {listed} FROM ratings))
          AS duplicate_rows,
        count(*) - count(DISTINCT "Word") AS duplicate_words,
        count(*) - count("{c}") AS "N_missing",
        {r(f'(count(*) - count("{c}"))::DOUBLE / count(*) * 100e0', 2)} AS "Pct_missing",
        (SELECT count(*) FROM ratings WHERE "Sadness" IS NULL) > 0 AS any_missing,
        {r(f'min("{c}")', 2)} AS observed_min, {r(f'max("{c}")', 2)} AS observed_max,
        (min("{c}") < 1 OR max("{c}") > 5) AS out_of_range FROM ratings""" for c in S.RATING_COLUMNS]
    return f"WITH {RATINGS} " + " UNION ALL ".join(rows)


def _describe(full: bool) -> str:
    cols = VARS if full else S.DERIVED_TARGETS
    if full:
        body = f"""SELECT name AS "Variable", count(value) AS "N", {r('avg(value)', 4)} AS "Mean",
          {r('stddev_samp(value)', 4)} AS "SD", {r('min(value)', 4)} AS "Min", {r('max(value)', 4)} AS "Max",
          {r('quantile_cont(value, 0.5)', 4)} AS "Median", {r('quantile_cont(value, 0.25)', 4)} AS "Q1",
          {r('quantile_cont(value, 0.75)', 4)} AS "Q3",
          {r('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)', 4)} AS "IQR",
          {r('avg(pow(value - mu, 3)) / pow(avg(pow(value - mu, 2)), 1.5)', 4)} AS "Skewness",
          {r('avg(pow(value - mu, 4)) / pow(avg(pow(value - mu, 2)), 2) - 3', 4)} AS "Kurtosis"
          FROM (SELECT *, avg(value) OVER (PARTITION BY name) AS mu FROM long) GROUP BY name"""
    else:
        body = f"""SELECT name AS "Variable", count(value) AS "count", {r('avg(value)', 4)} AS "mean",
          {r('stddev_samp(value)', 4)} AS "std", {r('min(value)', 4)} AS "min",
          {r('quantile_cont(value, 0.25)', 4)} AS "25%", {r('quantile_cont(value, 0.5)', 4)} AS "50%",
          {r('quantile_cont(value, 0.75)', 4)} AS "75%", {r('max(value)', 4)} AS "max"
          FROM long GROUP BY name"""
    return f"WITH {TARGETS}, long AS ({unpivot('processed', cols)}) {body}"


def _bands(inclusive: bool, primary_only: bool = False) -> str:
    bands = S.DEFAULT_SPEC.bands[:1] if primary_only else S.DEFAULT_SPEC.bands
    values = ", ".join(f"({i}, '{b.label}', '{b.text}', {b.lo}e0, {b.hi}e0)" for i, b in enumerate(bands))
    op = ">=" if inclusive else ">"
    means = ", ".join(f'{r(f"""avg("{c}")""", 4)} AS "mean_{c}"' for c in S.DERIVED_TARGETS)
    base = f"""WITH {TARGETS},
      q AS (SELECT quantile_cont("Ambivalence_product", 0.75) AS qp,
                   quantile_cont("Ambivalence_min", 0.75) AS qm, count(*) AS total FROM processed),
      bands(pos, label, txt, lo, hi) AS (VALUES {values}),
      stats AS (
        SELECT label AS threshold_label, txt AS valence_range, count("Word") AS n_near_neutral,
          {r('count("Word")::DOUBLE / any_value(total) * 100e0', 2)} AS pct_of_total, {means},
          {r(f'count(*) FILTER (WHERE "Ambivalence_product" {op} qp)::DOUBLE / nullif(count("Word"), 0) * 100e0', 2)}
            AS pct_high_ambivalence_product,
          {r(f'count(*) FILTER (WHERE "Ambivalence_min" {op} qm)::DOUBLE / nullif(count("Word"), 0) * 100e0', 2)}
            AS pct_high_ambivalence_min,
          {r('any_value(qp)', 4)} AS "high_amb_product_threshold_Q3",
          {r('any_value(qm)', 4)} AS "high_amb_min_threshold_Q3"
        FROM bands LEFT JOIN processed ON "Valence" BETWEEN lo AND hi, q GROUP BY label, txt),
      spread AS (SELECT max(pct_high_ambivalence_product) - min(pct_high_ambivalence_product) AS d FROM stats)"""
    if primary_only:
        return base + " SELECT * FROM stats"
    if not inclusive:
        return base + f""" SELECT stats.*, {r('d', 2)} AS max_diff,
          CASE WHEN d <= 5 THEN 'ROBUST' ELSE 'THRESHOLD-SENSITIVE' END AS verdict FROM stats, spread"""
    return base + """ SELECT 'Near-neutral threshold sensitivity' AS "check", threshold_label AS threshold,
        valence_range AS "range", n_near_neutral AS "N_near_neutral", pct_of_total AS "Pct_of_total",
        pct_high_ambivalence_product AS "Pct_high_ambivalence_Q3",
        concat('Max diff in %high-ambivalence across thresholds = ', printf('%.1f', d), '% - ',
          CASE WHEN d <= 5 THEN 'ROBUST (≤5%).' ELSE 'THRESHOLD-SENSITIVE (>5%); discuss.' END)
          AS sensitivity_conclusion FROM stats, spread"""


def _histogram(cols: tuple[str, ...] = VARS, bins: int = 50) -> str:
    return f"""WITH {TARGETS}, long AS ({unpivot('processed', cols)}),
      lim AS (SELECT name, count(value) AS total, min(value) AS lo, max(value) AS hi FROM long GROUP BY name),
      grid AS (SELECT name, total, b AS bin,
          lo + b * ((hi - lo) / {bins}) AS l,
          CASE WHEN b = {bins - 1} THEN hi ELSE lo + (b + 1) * ((hi - lo) / {bins}) END AS u,
          (hi - lo) / {bins} AS width
        FROM lim, range(0, {bins}) t(b)),
      counts AS (SELECT name, value, count(*) AS c FROM long WHERE value IS NOT NULL GROUP BY ALL),
      hit AS (SELECT g.name, g.bin, sum(c) AS n FROM grid g JOIN counts v ON v.name = g.name
        AND v.value >= g.l AND (v.value < g.u OR (g.bin = {bins - 1} AND v.value <= g.u)) GROUP BY ALL)
      SELECT g.name AS "Variable", g.bin AS bin, {r('l', 6)} AS bin_left, {r('u', 6)} AS bin_right,
        CAST(coalesce(n, 0) AS BIGINT) AS n, {r('coalesce(n, 0)::DOUBLE / (total * width)', 6)} AS density,
        (g.name = 'Valence' AND u >= 2.75e0 AND l <= 3.25e0) AS in_band
      FROM grid g LEFT JOIN hit h ON h.name = g.name AND h.bin = g.bin"""


def _kde(digits: int = 6) -> str:
    return f"""WITH {TARGETS}, long AS ({unpivot('processed', S.SIDE_BY_SIDE_VARIABLES)}),
      lim AS (SELECT name, count(value)::DOUBLE AS total, min(value) AS lo, max(value) AS hi,
          stddev_samp(value) * pow(count(value)::DOUBLE, -0.2e0) AS h FROM long GROUP BY name),
      counts AS (SELECT name, value, count(*) AS c FROM long WHERE value IS NOT NULL GROUP BY ALL)
      SELECT name AS "Variable", point, {r('any_value(x)', 6)} AS x,
        {r('sum(c * exp(-0.5e0 * pow((x - value) / h, 2))) / any_value(total * h * sqrt(2 * pi()))', digits)} AS density
      FROM (SELECT l.*, p AS point, lo + p * ((hi - lo) / 299) AS x FROM lim l, range(0, 300) t(p)) g
      JOIN counts USING (name) GROUP BY name, point"""


def _pairs(rank: bool) -> str:
    ids = "row_number() OVER () AS rid, *"
    long = unpivot("numbered", VARS, "rid,")
    pairs = f"""SELECT a.idx AS idx_a, b.idx AS idx_b, a.name AS var_a, b.name AS var_b,
        a.value AS va, b.value AS vb FROM long a JOIN long b USING (rid)
        WHERE a.value IS NOT NULL AND b.value IS NOT NULL"""
    if rank:
        pairs = f"""SELECT idx_a, idx_b, var_a, var_b,
          rank() OVER (PARTITION BY idx_a, idx_b ORDER BY va)
            + (count(*) OVER (PARTITION BY idx_a, idx_b, va) - 1) / 2e0 AS va,
          rank() OVER (PARTITION BY idx_a, idx_b ORDER BY vb)
            + (count(*) OVER (PARTITION BY idx_a, idx_b, vb) - 1) / 2e0 AS vb FROM ({pairs})"""
    return f"""WITH {TARGETS}, numbered AS (SELECT {ids} FROM processed), long AS ({long}),
      pairs AS ({pairs})
      SELECT idx_a, idx_b, var_a, var_b, count(*) AS n, {r('corr(va, vb)', 4)} AS r
      FROM pairs GROUP BY idx_a, idx_b, var_a, var_b"""


def _construct() -> str:
    rows = " UNION ALL ".join(
        f"""SELECT '{q}' AS "Question", '{a}' AS "Variable_A", '{b}' AS "Variable_B",
            corr("{a}", "{b}") AS raw, count(*) FILTER (WHERE "{a}" IS NOT NULL AND "{b}" IS NOT NULL) AS n
            FROM processed""" for q, a, b in S.CONSTRUCT_QUESTIONS)
    # p = tail share of the integral of cos(t)^(n-3); midpoint rule on a fine grid.
    return f"""WITH {TARGETS}, raw AS ({rows}),
      grid AS (SELECT "Question", asin(abs(raw)) AS a, n - 3 AS k,
          least(pi() / 2, 16 / sqrt(n - 3)) AS top, (i + 0.5e0) / 200000 AS u
        FROM raw, range(0, 200000) t(i)),
      tail AS (SELECT "Question",
          avg(pow(greatest(cos(a + u * (top - a)), 0), k)) * greatest(any_value(top - a), 0) AS hi,
          avg(pow(greatest(cos(u * least(a, top)), 0), k)) * any_value(least(a, top)) AS lo
        FROM grid GROUP BY "Question")
      SELECT "Question", "Variable_A", "Variable_B", {r('raw', 4)} AS "Pearson_r",
        {r('hi / (hi + lo)', 6)} AS p_value,
        CASE WHEN abs({r('raw', 4)}) >= 0.7 THEN 'Strong' WHEN abs({r('raw', 4)}) >= 0.4 THEN 'Moderate'
             WHEN abs({r('raw', 4)}) >= 0.2 THEN 'Weak' ELSE 'Negligible' END AS "Strength",
        CASE WHEN {r('raw', 4)} > 0 THEN 'positive' WHEN {r('raw', 4)} < 0 THEN 'negative' ELSE 'N/A' END
          AS "Direction"
      FROM raw JOIN tail USING ("Question")"""


DIGEST = ("md5(concat('42:', concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
          "l_extendedprice)))")


def _scatter() -> str:
    pairs = (("Valence", "PositiveAffect"), ("Valence", "NegativeAffect"),
             ("PositiveAffect", "NegativeAffect"), ("Ambivalence_product", "Ambivalence_min"))
    rows = " UNION ALL ".join(
        f"""SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, {r(f'corr("{a}", "{b}")', 3)} AS r
            FROM (SELECT * FROM processed WHERE "{a}" IS NOT NULL AND "{b}" IS NOT NULL
                  ORDER BY {DIGEST}, {KEYS} LIMIT 5000)""" for a, b in pairs)
    return f"WITH {TARGETS} {rows}"


def _exemplars() -> str:
    picks = (
        ('"Valence" BETWEEN 2.75e0 AND 3.25e0 AND "Ambivalence_product" <= bm', '"Ambivalence_product" ASC'),
        ('"Valence" BETWEEN 2.75e0 AND 3.25e0 AND "Ambivalence_product" > bm', '"Ambivalence_product" DESC'),
        ('"PositiveAffect" >= ph AND "NegativeAffect" <= nl', '"PositiveAffect" DESC'),
        ('"Valence" <= vl AND "NegativeAffect" >= nh', '"NegativeAffect" DESC'),
    )
    rows = " UNION ALL ".join(
        f"""SELECT * FROM (SELECT {KEYS}, "Word", {r('"Valence"', 6)} AS "Valence",
            {r('"PositiveAffect"', 6)} AS "PositiveAffect", {r('"NegativeAffect"', 6)} AS "NegativeAffect",
            "Ambivalence_product", '{label}' AS "Category"
          FROM processed AS p, lim WHERE {rule.replace('"Valence"', 'p."Valence"').replace('"PositiveAffect"', 'p."PositiveAffect"').replace('"NegativeAffect"', 'p."NegativeAffect"')}
          ORDER BY p.{order}, {KEYS} LIMIT 10)"""
        for label, (rule, order) in zip(S.EXEMPLAR_CATEGORIES, picks))
    return f"""WITH {TARGETS}, lim AS (SELECT
        quantile_cont("Ambivalence_product", 0.5) FILTER (WHERE "Valence" BETWEEN 2.75e0 AND 3.25e0) AS bm,
        quantile_cont("PositiveAffect", 0.75) AS ph, quantile_cont("NegativeAffect", 0.25) AS nl,
        quantile_cont("NegativeAffect", 0.75) AS nh, quantile_cont("Valence", 0.25) AS vl FROM processed)
      {rows}"""


def _coverage(pos: str) -> str:
    def split(variable: str, col: str) -> str:
        return f"""SELECT '{variable}' AS v, CASE WHEN "{col}" > c THEN 'High' WHEN "{col}" <= c THEN 'Low' END
          AS g, c AS cut, concat('Median split; cutoff = ', printf('%.4f', c)) AS note
          FROM processed, (SELECT quantile_cont("{col}", 0.5) AS c FROM processed)"""
    return f"""WITH {TARGETS}, long AS (
      {split('Frequency', 'Frequency_Zipf')} UNION ALL {split('Concreteness', 'Concreteness')}
      UNION ALL {split('Imageability', 'Imageability')}
      UNION ALL SELECT '{S.POS_VARIABLE}', {pos}, NULL, 'Nominal categories; no split applied' FROM processed
      UNION ALL SELECT '{S.NEAR_NEUTRAL_VARIABLE}',
        CASE WHEN "Valence" BETWEEN 2.75e0 AND 3.25e0 THEN 'Near-neutral [2.75,3.25]' ELSE 'Non-neutral' END,
        NULL, 'Near-neutral defined as Valence ∈ [2.75, 3.25]' FROM processed
      UNION ALL SELECT 'Ambivalence_product',
        CASE WHEN "Ambivalence_product" > c THEN 'High ambivalence (>75% quantile)'
             ELSE 'Low/moderate ambivalence' END,
        c, concat('High = above Q75 = ', printf('%.4f', c))
        FROM processed, (SELECT quantile_cont("Ambivalence_product", 0.75) AS c FROM processed)),
    cover AS (SELECT v AS "Variable", g AS "Subgroup", count(*) AS "N",
        {r('count(*)::DOUBLE / (SELECT count(*) FROM processed) * 100e0', 2)} AS "Pct_of_total",
        {r('any_value(cut)', 4)} AS "Cutoff", any_value(note) AS "Cutoff_note",
        (SELECT count(*) FROM long m WHERE m.v = long.v AND m.g IS NULL) AS "N_missing_in_var",
        CASE WHEN count(*) >= 50 THEN 'YES' ELSE 'WARN: N<50' END AS "Reliable"
      FROM long WHERE g IS NOT NULL GROUP BY v, g)"""


def _formula() -> str:
    return f"""{TARGETS},
      q AS (SELECT quantile_cont("Ambivalence_product", 0.75) AS qa, quantile_cont("Ambivalence_min", 0.75) AS qb
            FROM processed),
      ranked AS (SELECT "Ambivalence_product" AS a, "Ambivalence_min" AS b,
          rank() OVER (ORDER BY "Ambivalence_product")
            + (count(*) OVER (PARTITION BY "Ambivalence_product") - 1) / 2e0 AS ra,
          rank() OVER (ORDER BY "Ambivalence_min")
            + (count(*) OVER (PARTITION BY "Ambivalence_min") - 1) / 2e0 AS rb FROM processed),
      formula AS (SELECT 'Ambivalence formula comparison (product vs min)' AS "check", count(*) AS n,
        {r('corr(a, b)', 4)} AS "Pearson_r", {r('corr(ra, rb)', 4)} AS "Spearman_r",
        {r('avg(a)', 4)} AS mean_product, {r('stddev_samp(a)', 4)} AS "SD_product",
        {r('avg(b)', 4)} AS mean_min, {r('stddev_samp(b)', 4)} AS "SD_min",
        {r('avg(CASE WHEN (a >= qa) = (b >= qb) THEN 1e0 ELSE 0e0 END)', 4)} AS "top_Q3_agreement",
        CASE WHEN corr(a, b) >= 0.90 THEN 'Formulas are HIGHLY SIMILAR (r≥0.90); both can be reported as converging.'
        ELSE 'Formulas DIVERGE meaningfully; Ambivalence_min is more conservative. Report both and note the difference in thesis limitations.' END AS conclusion
      FROM ranked, q)"""


def _scaling() -> str:
    return f"""{AFFECT},
      m AS (SELECT min("PositiveAffect") pl, max("PositiveAffect") ph, avg("PositiveAffect") pm,
          stddev_samp("PositiveAffect") ps, min("NegativeAffect") nl, max("NegativeAffect") nh,
          avg("NegativeAffect") nm, stddev_samp("NegativeAffect") ns FROM affect),
      s AS (SELECT ("PositiveAffect" - pl) / (ph - pl) * (("NegativeAffect" - nl) / (nh - nl)) AS a,
          (("PositiveAffect" - pm) / ps - (pl - pm) / ps) / ((ph - pm) / ps - (pl - pm) / ps)
          * ((("NegativeAffect" - nm) / ns - (nl - nm) / ns) / ((nh - nm) / ns - (nl - nm) / ns)) AS b
        FROM affect, m),
      scaling AS (SELECT 'Scaling sensitivity' AS "check", 'Min-max to [0,1] (PRIMARY)' AS "Scaling_A",
        'Z-score → shift to [0,1]' AS "Scaling_B", {r('corr(a, b)', 4)} AS "Pearson_r_between",
        CASE WHEN corr(a, b) >= 0.95 THEN 'Ambivalence scores are ROBUST to scaling choice (r≥0.95).'
        ELSE 'Scaling choice has MATERIAL EFFECT on ambivalence; discuss in methods.' END
          AS conclusion FROM s)"""


def _robustness() -> str:
    bands = _bands(True).replace("WITH " + TARGETS + ",", "", 1).replace(" SELECT 'Near", ", bs AS (SELECT 'Near", 1)
    bands = bands.replace("      q AS (SELECT quantile_cont", "      bq AS (SELECT quantile_cont", 1)
    bands = bands.replace("BETWEEN lo AND hi, q GROUP", "BETWEEN lo AND hi, bq GROUP", 1) + ")"
    scaling = _scaling().replace(AFFECT + ",", "", 1)
    cols = ("check", "n", "Pearson_r", "Spearman_r", "mean_product", "SD_product", "mean_min", "SD_min",
            "top_Q3_agreement", "conclusion", "threshold", "range", "N_near_neutral", "Pct_of_total",
            "Pct_high_ambivalence_Q3", "sensitivity_conclusion", "Scaling_A", "Scaling_B", "Pearson_r_between")
    out = ", ".join(f"coalesce(CAST(\"{c}\" AS VARCHAR), 'N/A') AS \"{c}\"" for c in cols)
    return f"""WITH {_formula()}, {bands}, {scaling}
      SELECT {out} FROM (SELECT * FROM formula UNION ALL BY NAME SELECT * FROM bs
                         UNION ALL BY NAME SELECT * FROM scaling)"""


FOLD = "(('0x' || substr(md5(concat('42:', {key})), 1, 8))::BIGINT % 5 + 1)::INTEGER"
ROW_FOLD = FOLD.format(key="concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)")

NORM_ORACLES: dict[str, str] = {
    "audit_columns": _presence(),
    "audit_profile": _profile(),
    "audit_out_of_range": _out_of_range(),
    "audit_summary": _summary(),
    "audit_duplicate_rows": f"""WITH {RATINGS.rstrip()}, twice AS (SELECT * FROM ratings UNION ALL SELECT * FROM ratings WHERE "Concreteness" < 3)
      SELECT (SELECT count(*) FROM twice) - count(*) AS n_duplicates
      FROM (SELECT DISTINCT * FROM twice)""",
    "audit_duplicate_keys": f"""WITH {RATINGS} SELECT count(*) - count(DISTINCT "Word") AS n_duplicates
      FROM ratings""",
    "row_mean": f"""WITH {AFFECT} SELECT {KEYS}, {r('"PositiveAffect"', 6)} AS positive,
      {r('"NegativeAffect"', 6)} AS negative,
      {r('("Anger" + "Fear" + coalesce("Sadness", 0e0) + "Disgust" + "Surprise") / (CASE WHEN "Sadness" IS NULL THEN 4e0 ELSE 5e0 END)', 6)}
        AS negative_with_surprise, {r('"Sadness"', 6)} AS sadness_only FROM affect""",
    "minmax_scale": f"""WITH {TARGETS} SELECT {KEYS}, "PositiveAffect_01", "NegativeAffect_01" FROM processed""",
    "rescale_params": f"""WITH {AFFECT}
      SELECT 'PositiveAffect' AS "Column", min("PositiveAffect") AS "min", max("PositiveAffect") AS "max",
        '{S.RESCALE_NOTE}' AS note FROM affect
      UNION ALL SELECT 'NegativeAffect', min("NegativeAffect"), max("NegativeAffect"),
        '{S.RESCALE_NOTE}' FROM affect""",
    "zscore": f"""WITH {AFFECT}, m AS (SELECT avg("PositiveAffect") pm, stddev_samp("PositiveAffect") ps,
        avg("NegativeAffect") nm, stddev_samp("NegativeAffect") ns, avg("Sadness") sm, stddev_samp("Sadness") ss
        FROM affect)
      SELECT {KEYS}, {r('("PositiveAffect" - pm) / ps', 6)} AS "PositiveAffect_z",
        {r('("NegativeAffect" - nm) / ns', 6)} AS "NegativeAffect_z",
        {r('("Sadness" - sm) / ss', 6)} AS "Sadness_z" FROM affect, m""",
    "ambivalence": f"""WITH {TARGETS} SELECT {KEYS}, "PositiveAffect_01", "NegativeAffect_01",
      "Ambivalence_product", "Ambivalence_min" FROM processed""",
    "word_length": f"""WITH {RATINGS} SELECT {KEYS}, "Word", length("Word")::INTEGER AS "Length" FROM ratings""",
    "band_filter": f"""WITH {RATINGS} SELECT {KEYS}, "Word", "Valence" FROM ratings
      WHERE "Valence" BETWEEN 2.75e0 AND 3.25e0""",
    "descriptives": _describe(True),
    "derived_describe": _describe(False),
    "quantiles": f"""WITH {RATINGS}, long AS (
        {unpivot('ratings', ['Valence', 'Arousal', 'Sadness', 'Imageability'])})
      SELECT name AS "Variable", p AS prob, {r("CASE p WHEN 0.05e0 THEN quantile_cont(value, 0.05) WHEN 0.25e0 THEN quantile_cont(value, 0.25) WHEN 0.5e0 THEN quantile_cont(value, 0.5) WHEN 0.75e0 THEN quantile_cont(value, 0.75) ELSE quantile_cont(value, 0.95) END", 6)} AS value
      FROM long, (VALUES (0.05e0), (0.25e0), (0.5e0), (0.75e0), (0.95e0)) t(p) GROUP BY name, p""",
    "band_summary": _bands(False, primary_only=True),
    "band_sensitivity": _bands(False),
    "histogram": _histogram(),
    "histogram_paired": _histogram(S.SIDE_BY_SIDE_VARIABLES, 40),
    "kde_curve": _kde(),
    "kde_binned": _kde(4),
    "approx_quantiles": " UNION ALL ".join(
        f"""SELECT '{c}' AS "Variable", p AS prob, count({v}) AS n, true AS within FROM lineitem,
            (VALUES (0.05e0), (0.25e0), (0.5e0), (0.75e0), (0.95e0)) t(p) GROUP BY p"""
        for c, v in (("Valence", "1"), ("Arousal", "1"), ("Sadness", "nullif(l_linenumber, 7)"),
                     ("Imageability", "nullif(l_returnflag, 'R')"))),
    "cached_describe": _describe(False),
    "pearson_matrix": _pairs(False),
    "spearman_matrix": _pairs(True),
    "corr_lower_triangle": f"SELECT * FROM ({_pairs(False)}) WHERE idx_a >= idx_b",
    "construct_checks": _construct(),
    "scatter_corr": _scatter(),
    "top_k": f"""WITH {TARGETS} SELECT {KEYS}, "Word", "Valence", "PositiveAffect",
      {r('"NegativeAffect"', 6)} AS "NegativeAffect", "Ambivalence_product" FROM processed
      ORDER BY "Ambivalence_product" DESC, {KEYS} LIMIT 20""",
    "exemplars": _exemplars(),
    "seeded_sample": f"""WITH {TARGETS} SELECT {KEYS}, "Valence", "Ambivalence_product",
      "Valence" BETWEEN 2.75e0 AND 3.25e0 AS in_band FROM processed ORDER BY {DIGEST}, {KEYS} LIMIT 6000""",
    "seeded_sample_first": f"""WITH {RATINGS}, s AS (SELECT * FROM ratings ORDER BY {DIGEST}, {KEYS} LIMIT 6000)
      SELECT {KEYS}, "Valence", "Sadness", "Valence" BETWEEN 2.75e0 AND 3.25e0 AS in_band FROM s
      WHERE "Valence" IS NOT NULL AND "Sadness" IS NOT NULL""",
    "median_split": f"""WITH {RATINGS}, c AS (SELECT quantile_cont("Imageability", 0.5) AS cut FROM ratings)
      SELECT {KEYS}, "Imageability", CASE WHEN "Imageability" > cut THEN 'High'
        WHEN "Imageability" <= cut THEN 'Low' END AS subgroup, {r('cut', 6)} AS cutoff FROM ratings, c""",
    "subgroup_coverage": _coverage("coalesce(\"PoS\", 'Unknown')") + " SELECT * FROM cover",
    "small_subgroups": _coverage("concat_ws('-', \"PoS\", l_suppkey, l_linenumber)")
    + """ SELECT "Variable", "Subgroup", "N" FROM cover WHERE "N" < 50""",
    "formula_comparison": f"WITH {_formula()} SELECT * FROM formula",
    "band_sensitivity_ge": _bands(True),
    "source_sensitivity": f"""WITH {AFFECT}, b AS (SELECT *, ("Anger" + "Fear" + coalesce("Sadness", 0e0)
        + "Disgust" + "Surprise") / (CASE WHEN "Sadness" IS NULL THEN 4e0 ELSE 5e0 END) AS alt FROM affect)
      SELECT 'PRIMARY' AS "Version", 'mean(Anger, Fear, Sadness, Disgust)' AS "Formula",
        {r('avg("NegativeAffect")', 4)} AS "mean_NegativeAffect",
        {r('corr("NegativeAffect", "Valence")', 4)} AS "corr_with_Valence" FROM b
      UNION ALL SELECT 'EXPLORATORY ONLY - including Surprise',
        'mean(Anger, Fear, Sadness, Disgust, Surprise)', {r('avg(alt)', 4)},
        {r('corr(alt, "Valence")', 4)} FROM b""",
    "scaling_sensitivity": f"WITH {_scaling()} SELECT * FROM scaling",
    "robustness_summary": _robustness(),
    "minmax_scale_by_fold": f"""WITH {AFFECT}, f AS (SELECT *, {ROW_FOLD} AS fold FROM affect),
      t AS (SELECT a.fold, min(b.lo) AS lo, max(b.hi) AS hi
        FROM (SELECT DISTINCT fold FROM f) a
        JOIN (SELECT fold, min("NegativeAffect") AS lo, max("NegativeAffect") AS hi FROM f GROUP BY fold) b
          ON a.fold <> b.fold GROUP BY a.fold)
      SELECT {KEYS}, fold, {r('lo', 6)} AS train_min, {r('hi', 6)} AS train_max,
        {r('("NegativeAffect" - lo) / (hi - lo)', 6)} AS "NegativeAffect_01" FROM f JOIN t USING (fold)""",
}


LEXICON = r"""lexicon AS (
  SELECT w, count(*) AS n_docs, avg(CASE WHEN lang = 'en' THEN 1e0 ELSE 0e0 END) AS en_share,
    avg(quality) AS pos, avg(toxic) AS neg
  FROM (SELECT doc_id, lang, unnest(list_distinct(list_filter(
          regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda t: t <> ''))) AS w FROM documents)
  LEFT JOIN labels USING (doc_id) GROUP BY w)"""

GRAMS = """flatten(list_transform(range(2, least(4, length(w) + 2) + 1),
  lambda n: list_transform(range(1, length(w) + 2 - n + 2), lambda i: substring(' ' || w || ' ', i, n))))"""

WORD_FOLD = FOLD.format(key="w")
INNER_FOLD = "(('0x' || substr(md5(concat('42-inner:', w)), 1, 8))::BIGINT % 3 + 1)::INTEGER"

TERMS = f"""{LEXICON},
terms AS (SELECT w, gram, count(*) AS tf FROM (SELECT w, unnest({GRAMS}) AS gram FROM lexicon) GROUP BY w, gram),
vocab AS (SELECT gram, count(*) AS df, sum(tf)::BIGINT AS tf FROM terms GROUP BY gram HAVING count(*) >= 3
          ORDER BY sum(tf) DESC, gram LIMIT 50000)"""

WORDS = f"""{LEXICON},
kept AS (SELECT *, {WORD_FOLD} AS outer_fold FROM lexicon),
words AS (SELECT *, {r('(pos - (SELECT min(pos) FROM kept)) / (SELECT max(pos) - min(pos) FROM kept) * ((neg - (SELECT min(neg) FROM kept)) / (SELECT max(neg) - min(neg) FROM kept))', 6)}
  AS mixed FROM kept)"""


def _metrics(y: str, p: str) -> str:
    return f"""{r(f'avg(abs({y} - {p}))', 4)} AS "MAE", {r(f'sqrt(avg(pow({y} - {p}, 2)))', 4)} AS "RMSE",
      {r(f"CASE WHEN stddev_pop({p}) > 0 AND stddev_pop({y}) > 0 THEN corr({y}, {p}) ELSE 0 END", 4)}
        AS "Pearson_r" """


SUMMARY = ", ".join(
    f'{r(f"""avg("{m}")""", 4)} AS "{m}_mean", {r(f"""stddev_pop("{m}")""", 4)} AS "{m}_SD"'
    for m in ("MAE", "RMSE", "Pearson_r"))


def _dummy() -> str:
    long = " UNION ALL ".join(f"SELECT '{t}' AS target, outer_fold, {t} AS y FROM words WHERE {t} IS NOT NULL"
                              for t in ("en_share", "pos", "neg", "mixed"))
    return f"""WITH {WORDS}, long AS ({long}),
      totals AS (SELECT target, outer_fold, sum(y) AS s, count(*) AS c FROM long GROUP BY ALL),
      means AS (SELECT a.target, a.outer_fold, sum(b.s) / sum(b.c) AS p FROM totals a
        JOIN totals b ON a.target = b.target AND a.outer_fold <> b.outer_fold GROUP BY ALL),
      scored AS (SELECT target, outer_fold, {r('avg(abs(y - p))', 4)} AS "MAE",
        {r('sqrt(avg(pow(y - p, 2)))', 4)} AS "RMSE", 0e0 AS "Pearson_r"
        FROM long JOIN means USING (target, outer_fold) GROUP BY target, outer_fold)
      SELECT target, {SUMMARY} FROM scored GROUP BY target"""


def _dense(select: str) -> str:
    """Nested ridge on the embeddings: Gram sums by fold cell, Gauss-Jordan elimination, then ``select``.

    ``coefs`` has the coefficients of every (outer, inner, alpha), inner 0 being the refit; ``scores`` the mean
    inner r of each alpha; ``oof`` the predictions of the chosen one.
    """
    fits = ", ".join(f"({o}, {i})" for o in range(1, 6) for i in range(4))
    alphas = ", ".join(f"({a}::DOUBLE)" for a in S.DEFAULT_SPEC.ridge_alphas)
    inner = INNER_FOLD.replace("w)", "vec_id)")
    return f"""WITH RECURSIVE items AS (SELECT vec_id, label::DOUBLE AS y, embedding::DOUBLE[] AS x,
        {FOLD.format(key='vec_id')} AS of, {inner} AS nf FROM embeddings),
      size AS (SELECT max(len(x)) AS d FROM items),
      fits(o, i) AS (VALUES {fits}), alphas(a) AS (VALUES {alphas}),
      long AS (SELECT vec_id, of, nf, unnest([1::DOUBLE] || x || [y]) AS v, unnest(range(0, len(x) + 2)) AS c FROM items),
      cells AS (SELECT p.of, p.nf, p.c AS r, q.c, sum(p.v * q.v) AS g FROM long p JOIN long q USING (vec_id) GROUP BY ALL),
      grams AS (SELECT o, i, r, c, sum(g) AS g FROM fits JOIN cells ON of <> o AND nf <> i GROUP BY ALL),
      means AS (SELECT o, i, c, g / max(g) FILTER (WHERE c = 0) OVER (PARTITION BY o, i) AS m,
                       max(g) FILTER (WHERE c = 0) OVER (PARTITION BY o, i) AS n FROM grams WHERE r = 0),
      cov AS (SELECT o, i, g.r, g.c, g.g - a.n * a.m * b.m AS v FROM grams g
              JOIN means a USING (o, i) JOIN means b USING (o, i) WHERE a.c = g.r AND b.c = g.c AND g.r > 0 AND g.c > 0),
      systems AS (SELECT o, i, a, r, list(v + CASE WHEN r = c THEN a ELSE 0 END ORDER BY c) AS v
                  FROM cov, alphas, size WHERE r <= d GROUP BY o, i, a, r),
      elim AS (SELECT 1 AS k, o, i, a, r, v FROM systems
        UNION ALL
        SELECT e.k + 1, e.o, e.i, e.a, e.r, CASE WHEN e.r = e.k THEN list_transform(e.v, lambda z: z / e.v[e.k])
            ELSE list_transform(list_zip(e.v, p.v), lambda z: z[1] - e.v[e.k] / p.v[e.k] * z[2]) END
        FROM elim e JOIN elim p ON e.o = p.o AND e.i = p.i AND e.a = p.a AND p.r = e.k, size WHERE e.k <= d),
      coefs AS (SELECT o, i, a, list(v[d + 1] ORDER BY r) AS w FROM elim, size WHERE k = d + 1 GROUP BY o, i, a),
      inners AS (SELECT o, i, a, list_dot_product(x, w) AS p, y FROM coefs JOIN items ON of <> o AND nf = i),
      rs AS (SELECT o, i, a, CASE WHEN stddev_pop(p) > 0 AND stddev_pop(y) > 0 THEN corr(p, y) ELSE 0 END AS r FROM inners GROUP BY ALL),
      scores AS (SELECT o, a, avg(r) AS r FROM rs GROUP BY ALL),
      best AS (SELECT o, arg_max(a, (r, -a)) AS a FROM scores GROUP BY o),
      centre AS (SELECT o, list(m ORDER BY c) FILTER (WHERE c BETWEEN 1 AND d) AS mx, max(m) FILTER (WHERE c = d + 1) AS my
                 FROM means, size WHERE i = 0 GROUP BY o),
      oof AS (SELECT vec_id, of, y, my + list_dot_product(x, w) - list_dot_product(mx, w) AS p
              FROM items JOIN best ON of = best.o JOIN coefs ON coefs.o = best.o AND coefs.a = best.a AND coefs.i = 0
              JOIN centre ON centre.o = best.o)
      {select}"""


def _fold_fit() -> str:
    fits = ", ".join(f"({o}, {i})" for o in range(1, 6) for i in range(4))
    return f"""WITH {LEXICON},
      words AS (SELECT w, {WORD_FOLD} AS of, {INNER_FOLD} AS nf FROM lexicon),
      terms AS (SELECT w, of, nf, gram, count(*) AS tf
        FROM (SELECT w, of, nf, unnest({GRAMS}) AS gram FROM words) GROUP BY ALL),
      fits(o, i) AS (VALUES {fits}),
      sizes AS (SELECT o, i, count(*) AS n FROM fits JOIN words ON of <> o AND nf <> i GROUP BY ALL),
      counted AS (SELECT o, i, gram, count(*) AS df, sum(tf)::BIGINT AS tf
        FROM fits JOIN terms ON of <> o AND nf <> i GROUP BY ALL HAVING count(*) >= 3),
      placed AS (SELECT *, row_number() OVER (PARTITION BY o, i ORDER BY tf DESC, gram) AS place FROM counted)
      SELECT o AS "outer", i AS "inner", gram, df, tf, {r('ln((1e0 + n) / (1e0 + df)) + 1', 6)} AS idf
      FROM placed JOIN sizes USING (o, i) WHERE place <= 50000"""


def _unit(salt: str) -> str:
    """A seeded number in (0, 1) of an entry of a random vector."""
    return f"((('0x' || substr(md5(concat('42:', '{salt}', i, ':', vec_id)), 1, 8))::BIGINT + 0.5e0) / 4294967296e0)"


VALUES = "SELECT vec_id, label, unnest(embedding) AS value, unnest(range(0, len(embedding)))::INTEGER AS dim FROM embeddings"
LEXICON_ORACLES: dict[str, str] = {
    "char_ngrams": f"WITH {LEXICON} SELECT w, len({GRAMS})::INTEGER AS n_grams, array_to_string({GRAMS}, '|') AS grams FROM lexicon",
    "ngram_vocab": f"WITH {TERMS} SELECT * FROM vocab",
    "tfidf": f"""WITH {TERMS}, n AS (SELECT count(*) AS n FROM lexicon),
      raw AS (SELECT w, gram, terms.tf, terms.tf * (ln((1e0 + n) / (1e0 + df)) + 1) AS x
        FROM terms JOIN vocab USING (gram), n)
      SELECT w, gram, tf, {r('x / sqrt(sum(x * x) OVER (PARTITION BY w))', 6)} AS weight FROM raw""",
    "tfidf_fold_fit": _fold_fit(),
    "feature_report": f"""WITH {TERMS} SELECT 'Character n-grams (TF-IDF)' AS "Representation_family",
      (SELECT count(*) FROM vocab) AS "Dimensionality", count(w) AS n_covered, count(*) AS n_total,
      concat(count(w), '/', count(*), ' words') AS "Coverage",
      'lowercase; diacritics preserved; no stemming' AS "Preprocessing",
      'ngram_range=2–4, min_df=3, max_features≤50000' AS "Key_parameters" FROM lexicon""",
    "cv_folds_balanced": f"""WITH {LEXICON}, h AS (SELECT w, ('0x' || substr(md5(concat('42:', w)), 1, 8))::BIGINT AS a,
        ('0x' || substr(md5(concat('42-inner:', w)), 1, 8))::BIGINT AS b FROM lexicon)
      SELECT w, ((row_number() OVER (ORDER BY a, w) - 1) % 5 + 1)::INTEGER AS outer_fold,
        ((row_number() OVER (ORDER BY b, w) - 1) % 3 + 1)::INTEGER AS inner_fold FROM h""",
    "cv_folds": f"WITH {LEXICON} SELECT w, {WORD_FOLD} AS outer_fold, {INNER_FOLD} AS inner_fold FROM lexicon",
    "target_gate": f"WITH {LEXICON} " + " UNION ALL ".join(
        f"SELECT '{t}' AS target, count({t}) AS n_valid, count({t}) >= 100 AS usable FROM lexicon"
        for t in ("en_share", "pos", "neg")),
    "dummy_baseline": _dummy(),
    "fold_metrics": f"""WITH {WORDS} SELECT outer_fold, count(*) AS n, {_metrics('pos', 'en_share')}
      FROM words WHERE pos IS NOT NULL GROUP BY outer_fold""",
    "cv_summary": f"""WITH {WORDS}, f AS (SELECT outer_fold, {_metrics('pos', 'en_share')}
      FROM words WHERE pos IS NOT NULL GROUP BY outer_fold) SELECT {SUMMARY} FROM f""",
}
VECTOR_ORACLES: dict[str, str] = {
    "embedding_wide": "SELECT vec_id, " + ", ".join(f'embedding[{i + 1}] AS "{i}"' for i in range(64))
    + " FROM embeddings",
    "embedding_lookup": f"""SELECT vec_id, label = 9 AS oov, dim,
      CASE WHEN label = 9 THEN 0::FLOAT ELSE value END AS value FROM ({VALUES})""",
    "embedding_lookup_bucketed": f"""SELECT vec_id, label = 9 AS oov, dim,
      CASE WHEN label = 9 THEN 0::FLOAT ELSE value END AS value FROM ({VALUES})""",
    "oov_rate": """SELECT count(*) AS n_words, count(*) FILTER (WHERE label = 9) AS n_missing,
      count(*) FILTER (WHERE label = 9)::DOUBLE / count(*) AS oov_rate FROM embeddings""",
    "masked_mean_pool": f"""SELECT word_id, sum(m)::BIGINT AS n_tokens, dim,
      {r('sum(value::DOUBLE * m) / greatest(sum(m), 1)', 6)} AS value FROM (
        SELECT label AS word_id, dim, value, CASE WHEN label = 9 OR vec_id % 3 = 0 THEN 0 ELSE 1 END AS m
        FROM ({VALUES})) GROUP BY word_id, dim""",
    "embedding_alignment": """SELECT count(*) FILTER (WHERE label = 9) AS n_missing,
      count(*) FILTER (WHERE label = 8) AS n_extra, count(*) FILTER (WHERE label = 0) AS n_duplicate
      FROM embeddings""",
    "embedding_shape": """SELECT count(*) AS n, min(len(embedding))::INTEGER AS min_dim,
      max(len(embedding))::INTEGER AS max_dim FROM embeddings""",
    "embedding_lookup_random": f"""WITH r AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE label = 9),
      u AS (SELECT *, {_unit('r')} AS u, {_unit('a')} AS v FROM r)
      SELECT vec_id, true AS oov, (i - 1)::INTEGER AS dim,
        {r("(sqrt(ln(u) * -2e0) * cos(v * 6.283185307179586e0) * 0.01e0)::FLOAT::DOUBLE", 5)} AS value FROM u""",
    "ridge_cv_embeddings": _dense(f"""SELECT 'y' AS target, of AS outer_fold, count(*) AS n, {_metrics('y', 'p')} FROM oof GROUP BY of"""),
    "alpha_search": _dense(f"""SELECT 'y' AS target, o AS outer_fold, scores.a AS alpha, {r('scores.r', 6)} AS inner_r,
        scores.a = best.a AS chosen FROM scores JOIN best USING (o)"""),
    "oof_predictions": _dense(f"SELECT vec_id, of AS outer_fold, y, {r('p', 6)} AS prediction FROM oof"),
    "vec_text_scan": f"SELECT vec_id::VARCHAR AS word, dim, value FROM ({VALUES})",
}
ORACLES: dict[str, str] = {**NORM_ORACLES, **LEXICON_ORACLES, **VECTOR_ORACLES}
