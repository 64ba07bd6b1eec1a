"""Registered queries: keyword statistics, calibration sweeps, earlier scoring generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta.operators import sweep as sw
from vacanta.operators import triple_lock as tl
from vacanta.operators.dictionary import dictionary_frame, layer_of
from vacanta.operators.match import match_keywords, match_longest_first, signatures
from vacanta.operators.reports import keyword_time_series
from vacanta.operators.trend import (
    keyword_breakeven,
    keyword_counts,
    keyword_g1,
    keyword_g2_at_c,
    keyword_stats_wide,
    keyword_trend,
)
from vacanta.plans import sql
from vacanta.plans.catalog_text import RAW_HITS, matched
from vacanta.plans.pipeline import Calibration, calibrate
from vacanta.plans.registry import query
from vacanta.plans.views import TEST_DICTIONARY, ads
from vacanta.sources.staging import new_path, stage

_KEYWORDS = "(SELECT keyword FROM dict)"
_T = f"WITH {sql.HITS}, {sql.TREND.format(kws=_KEYWORDS)}"


def _dict(spark: SparkSession) -> DataFrame:
    return dictionary_frame(spark, TEST_DICTIONARY)


def _counts(spark, sf_dir) -> DataFrame:
    return keyword_counts(signatures(matched(spark, sf_dir), "year"), "year")


def _trend(spark, sf_dir) -> DataFrame:
    return keyword_trend(_dict(spark), _counts(spark, sf_dir))


def _staged(spark, sf_dir) -> DataFrame:
    return stage(signatures(matched(spark, sf_dir), "year"), "signatures")


def _calibrated(spark, sf_dir) -> Calibration:
    return calibrate(_staged(spark, sf_dir), _dict(spark))


@query(
    "keyword_counts_yearly",
    f"""WITH {sql.HITS} SELECT year, bucket, keyword, count(*) AS n FROM hits
    WHERE keyword NOT IN ('Tion', 'Copilot') GROUP BY ALL""",
)
def keyword_counts_yearly(spark, sf_dir):
    sigs = signatures(matched(spark, sf_dir), "year")
    return keyword_counts(sigs, "year", excluded=("Tion", "Copilot"))


@query(
    "keyword_trend_ols",
    f"""{_T} SELECT keyword, lang, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
      round(mean, 6) AS mean, round(yhat, 6) AS yhat FROM trend""",
)
def keyword_trend_ols(spark, sf_dir):
    return _trend(spark, sf_dir).select("keyword", "lang", "slope", "intercept", "mean", "yhat")


@query("keyword_benchmark", f'{_T} SELECT keyword, lang, round(b, 6) AS "B", y_val FROM trend')
def keyword_benchmark(spark, sf_dir):
    return _trend(spark, sf_dir).select("keyword", "lang", "B", "y_val")


@query("keyword_g1", f"{_T} SELECT * FROM g1")
def keyword_g1_query(spark, sf_dir):
    return keyword_g1(_trend(spark, sf_dir))


@query("keyword_g2_at_c", f"{_T} SELECT c, keyword FROM g2")
def keyword_g2_at_c_query(spark, sf_dir):
    return keyword_g2_at_c(_trend(spark, sf_dir))


_SWEEP = """sweep AS (
  SELECT cs.c, ks.k, (SELECT count(*) FROM g2 WHERE g2.c = cs.c) AS n_g2_keywords,
         (SELECT count(*) FROM g1 WHERE is_g1) AS n_g1_keywords,
         (SELECT count(*) FROM adc WHERE adc.c = cs.c AND (n1 >= 1 OR n2 >= k)) AS flagged_ads,
         (SELECT count(*) FROM ads WHERE year = 2025) AS total_ads
  FROM cs CROSS JOIN ks)"""
_NO_LLM = "(SELECT keyword FROM dict WHERE source <> 'LLM')"


@query(
    "v7_grid_sweep",
    f"""{_T}, {_SWEEP} SELECT 'full' AS run, *, round(100.0 * flagged_ads / total_ads, 6) AS flagged_share_pct FROM sweep
    UNION ALL
    (WITH {sql.HITS}, {sql.TREND.format(kws=_NO_LLM)}, {_SWEEP}
     SELECT 'no_layer3', *, round(100.0 * flagged_ads / total_ads, 6) FROM sweep)""",
)
def v7_grid_sweep(spark, sf_dir):
    """Full keyword pool and the pool without one source, from the same staged signatures."""
    sigs = _staged(spark, sf_dir)
    dropped = tuple(k.keyword for k in TEST_DICTIONARY.keywords if k.source == "LLM")
    full = calibrate(sigs, _dict(spark)).sweep().withColumn("run", F.lit("full"))
    part = calibrate(sigs, _dict(spark), dropped).sweep().withColumn("run", F.lit("no_layer3"))
    return full.unionByName(part)


@query(
    "v7_grid_matrix",
    f"""{_T}, {_SWEEP}, s AS (SELECT c, k, round(100.0 * flagged_ads / total_ads, 6) AS p FROM sweep)
    SELECT c, max(p) FILTER (k = 1) AS "1", max(p) FILTER (k = 2) AS "2", max(p) FILTER (k = 3) AS "3",
      max(p) FILTER (k = 4) AS "4", max(p) FILTER (k = 5) AS "5" FROM s GROUP BY c""",
)
def v7_grid_matrix(spark, sf_dir):
    return sw.grid_matrix(_calibrated(spark, sf_dir).sweep())


@query(
    "elbow_k",
    f"""{_T}, {_SWEEP}, s AS (SELECT c, k, 100.0 * flagged_ads / total_ads AS p FROM sweep),
    d AS (SELECT c, k, abs(p - lag(p) OVER w) AS step FROM s WINDOW w AS (PARTITION BY c ORDER BY k)),
    f AS (SELECT c, step AS first_step FROM d WHERE k = 2)
    SELECT c, coalesce(min(k) FILTER (k >= 3 AND first_step > 0 AND step <= 0.1 * first_step), 5) AS elbow_k
    FROM d JOIN f USING (c) GROUP BY c""",
)
def elbow_k(spark, sf_dir):
    return sw.elbow_k(_calibrated(spark, sf_dir).sweep())


@query(
    "keyword_stats_wide",
    f"""{_T} SELECT keyword, any_value(g1.zero_pre) AS zero_pre, any_value(g1.y_val_all_langs) AS y_val_all_langs,
      any_value(g1.is_g1) AS is_g1, {", ".join(
        f'''max(round_even(b, 2)) FILTER (lang = '{la}') AS "B_{la}", max(y_val) FILTER (lang = '{la}') AS y_val_{la},
        max(CASE WHEN b > 0 THEN round_even(y_val / b, 2) END) FILTER (lang = '{la}') AS multiple_{la}'''
        for la in ("en", "de", "fr", "it"))}
    FROM trend JOIN g1 USING (keyword) GROUP BY keyword""",
)
def keyword_stats_wide_query(spark, sf_dir):
    return keyword_stats_wide(_trend(spark, sf_dir))


_BREAK = """mult AS (
  SELECT *, CASE WHEN b > 0 THEN y_val / b WHEN y_val > 0 THEN 'inf'::DOUBLE ELSE 0 END AS m FROM trend),
be AS (SELECT keyword, lang AS best_lang, m AS breakeven_c, b, y_val, mean FROM mult
  QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY round(m, 9) DESC, rk) = 1)"""


@query(
    "keyword_breakeven",
    f"""{_T}, {_BREAK} SELECT keyword, best_lang, round(breakeven_c, 6) AS breakeven_c, round(b, 6) AS "B_best",
      y_val AS y_val_best, round(mean, 6) AS mean_best FROM be""",
)
def keyword_breakeven_query(spark, sf_dir):
    return keyword_breakeven(_trend(spark, sf_dir))


# The example cell of the grid: c = 1.05, k = 2.
_AT = 1


@query(
    "v7_newly_flagged",
    f"""{_T}, f AS (SELECT ad_id, n1 >= 1 AS g, n1 >= 1 OR n2 >= 2 AS fl FROM adc WHERE c = 1.05),
    t AS (SELECT count(*) FILTER (g) AS g1_alone_total, count(*) FILTER (fl) AS flagged_total,
      count(*) FILTER (fl AND NOT g) AS newly FROM f),
    d AS (SELECT keyword, count(*) AS n_ads FROM f JOIN kwad USING (ad_id)
      JOIN g2 USING (keyword) WHERE g2.c = 1.05 AND fl AND NOT g GROUP BY keyword)
    SELECT keyword, n_ads, round(n_ads / newly, 6) AS share,
      n_ads / newly >= 0.5 AND n_ads = max(n_ads) OVER () AS dominant,
      g1_alone_total, flagged_total, newly AS newly_flagged FROM d CROSS JOIN t""",
)
def v7_newly_flagged(spark, sf_dir):
    run = _calibrated(spark, sf_dir)
    counted, status = run.counted, run.status
    totals = sw.newly_flagged(counted, _AT, 2)
    row = totals.agg(F.first(F.struct("*"))).scalar()
    out = sw.newly_flagged_drivers(counted, status, _AT, 2).withColumn("_t", row)
    return out.select("keyword", "n_ads", "share", "dominant", "_t.*")


@query(
    "keyword_flagged_counts",
    f"""{_T} SELECT keyword, count(*) FILTER (n1 >= 1 OR n2 >= 2) AS flagged_k2,
      count(*) FILTER (n1 >= 1 OR n2 >= 3) AS flagged_k3
    FROM kwad JOIN adc USING (ad_id) WHERE c = 1.05 GROUP BY keyword""",
)
def keyword_flagged_counts(spark, sf_dir):
    return sw.keyword_flagged_counts(_calibrated(spark, sf_dir).counted, _AT, (2, 3))


@query(
    "keyword_report",
    f"""{_T}, {_BREAK}, fl AS (SELECT keyword, count(*) FILTER (n1 >= 1 OR n2 >= 2) AS flagged_k2
      FROM kwad JOIN adc USING (ad_id) WHERE c = 1.05 GROUP BY keyword),
    r AS (SELECT d.keyword, CASE WHEN d.en <> d.keyword THEN d.en ELSE '' END AS matched_text, is_g1,
        CASE WHEN is_g1 THEN 2 WHEN y_val_all_langs > 0 THEN 1 ELSE 3 END AS block,
        y_val_all_langs, recent_total, best_lang, CASE WHEN NOT is_g1 THEN breakeven_c END AS be_c,
        coalesce(flagged_k2, 0) AS flagged_k2
      FROM dict d JOIN g1 USING (keyword) JOIN be USING (keyword) LEFT JOIN fl USING (keyword))
    SELECT keyword, matched_text, is_g1, CAST(block AS BIGINT) AS block, y_val_all_langs, recent_total, best_lang,
      round(be_c, 6) AS breakeven_c, flagged_k2, block = 1 AND round_even(be_c, 2) <= 5 AS would_cut,
      row_number() OVER (PARTITION BY block ORDER BY CASE WHEN block = 1 THEN round_even(be_c, 2) END,
        CASE WHEN block < 3 THEN -y_val_all_langs END, keyword) AS position FROM r""",
)
def keyword_report(spark, sf_dir):
    run = _calibrated(spark, sf_dir)
    flagged = sw.keyword_flagged_counts(run.counted, _AT, (2,))
    out = sw.keyword_report(keyword_breakeven(run.trend), keyword_g1(run.trend), flagged, _dict(spark))
    return out.select(
        "keyword", "matched_text", "is_g1", "block", "y_val_all_langs", "recent_total", "best_lang",
        "breakeven_c", "flagged_k2", F.coalesce("would_cut", F.lit(False)).alias("would_cut"), "position",
    )


# Two English-only candidates join the pool for the layer analysis.
_CANDIDATES = ("Shing", "And the")
_LAYERS = """layers AS (
  SELECT keyword, CASE WHEN keyword = 'Hest' THEN '3a' WHEN keyword IN ('Ones', 'Shing', 'And the') THEN '3b'
    WHEN source IN ('St', 'H&L') THEN '1+2' ELSE '3a' END AS layer
  FROM (SELECT keyword, source FROM dict UNION ALL VALUES ('Shing', 'new'), ('And the', 'new'))),
other AS (
  SELECT ad_id, count(*) AS n, bool_or(layer = '1+2') AS b, bool_or(layer = '3a') AS c, bool_or(layer = '3b') AS d
  FROM kwad JOIN g1 USING (keyword) JOIN layers USING (keyword) WHERE NOT is_g1 GROUP BY ad_id)"""
_EXTRA_HITS = (
    sql.HITS.replace("hits AS (", "hits0 AS (")
    + r""", hits AS (
  SELECT ad_id, language, year, month, occupation, bucket, keyword, grp FROM hits0
  UNION ALL SELECT ad_id, language, year, month, occupation, 'en', 'Shing', NULL FROM norm WHERE regexp_matches(n, '\bshing\b')
  UNION ALL SELECT ad_id, language, year, month, occupation, 'en', 'And the', NULL FROM norm WHERE regexp_matches(n, '\band the\b'))"""
)
_T_EXTRA = f"""WITH {_EXTRA_HITS}, {sql.TREND.format(
    kws="(SELECT keyword FROM dict UNION ALL VALUES ('Shing'), ('And the'))")}, {_LAYERS}"""


def _layered(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    words = TEST_DICTIONARY.extended(_CANDIDATES)
    sigs = stage(signatures(match_keywords(ads(spark, sf_dir), words), "year"), "signatures")
    names = dictionary_frame(spark, words)
    trend = stage(keyword_trend(names, keyword_counts(sigs, "year")), "trend")
    g1 = keyword_g1(trend).where("is_g1").select("keyword")
    layer = layer_of(F.col("keyword"), F.col("source"), ("Hest",), ("Ones",), _CANDIDATES)
    return sigs, names.select("keyword", layer.alias("layer")), g1


@query(
    "layer_sweep",
    f"""{_T_EXTRA}, s AS (
      SELECT k, count(*) FILTER (n >= k) AS "A_total", count(*) FILTER (n >= k AND b) AS "B_layer12",
        count(*) FILTER (n >= k AND c) AS "C_layer3a", count(*) FILTER (n >= k AND d) AS "D_layer3b"
      FROM other CROSS JOIN ks GROUP BY k)
    SELECT *, round_even(100.0 * "B_layer12" / "A_total", 1) AS "B_pct_of_A", round_even(100.0 * "C_layer3a" / "A_total", 1) AS "C_pct_of_A",
      round_even(100.0 * "D_layer3b" / "A_total", 1) AS "D_pct_of_A" FROM s""",
)
def layer_sweep(spark, sf_dir):
    return sw.layer_sweep(*_layered(spark, sf_dir))


@query(
    "layer_drivers",
    f"""{_T_EXTRA}, t AS (SELECT ad_id FROM other WHERE n >= 2 AND d)
    SELECT keyword, count(*) AS n_ads, round(count(*) / (SELECT count(*) FROM t), 6) AS share
    FROM t JOIN kwad USING (ad_id) JOIN layers USING (keyword) JOIN g1 USING (keyword)
    WHERE layer = '3b' AND NOT is_g1 GROUP BY keyword""",
)
def layer_drivers(spark, sf_dir):
    return sw.layer_drivers(sw.with_layers(*_layered(spark, sf_dir)), 2)


# ---- earlier generation -------------------------------------------------------------------------

# Thresholds under which the generated corpus reaches every group.
RULES = tl.RuleConfig(dhs_g1=1.9, dhs_g2=0.3, dhs_g3=0.0, ratio_g2=1.2, ratio_g3=0.8, min_intensity=0.005)


def _raw_matched(spark, sf_dir) -> DataFrame:
    return match_longest_first(ads(spark, sf_dir), TEST_DICTIONARY)


def _raw_signatures(spark, sf_dir) -> DataFrame:
    return stage(signatures(_raw_matched(spark, sf_dir), "year", "occupation"), "signatures")


def _groups(spark, sigs: DataFrame) -> DataFrame:
    groups = tl.dhs_groups(_dict(spark), keyword_counts(sigs, "year"), RULES)
    return stage(groups, "groups")


_R = f"WITH {RAW_HITS}, hits AS (SELECT * FROM rhits WHERE pre)"
_DHS = f"""{_R}, rl(lang) AS (VALUES ('en'), ('de'), ('fr'), ('it'), ('rm'), ('sq'), ('es'), ('pt')),
yc AS (SELECT year, bucket AS lang, keyword, count(*) AS n FROM hits GROUP BY ALL),
dense AS (SELECT d.keyword, rl.lang, y.y AS year, coalesce(yc.n, 0) AS n FROM dict d CROSS JOIN rl
  CROSS JOIN (SELECT unnest(range(2012, 2026)) AS y) y
  LEFT JOIN yc ON yc.keyword = d.keyword AND yc.lang = rl.lang AND yc.year = y.y),
fit AS (SELECT keyword, lang, regr_slope(n, year - 2012) FILTER (year <= 2021) AS slope,
  regr_intercept(n, year - 2012) FILTER (year <= 2021) AS intercept,
  sum(n) FILTER (year <= 2018) / 7 AS baseline, CAST(sum(n) FILTER (year = 2025) AS DOUBLE) AS y
  FROM dense GROUP BY keyword, lang),
sc AS (SELECT *, round(intercept + 13 * slope, 9) AS yp, CASE WHEN baseline = 0 THEN 0 ELSE y / baseline END AS ratio,
  sum(y) OVER (PARTITION BY keyword) AS hits_all FROM fit),
dh AS (SELECT *, CASE WHEN y + greatest(0, yp) > 0 THEN round(2 * (y - yp) / (y + greatest(0, yp)), 9) ELSE 0 END AS dhs FROM sc),
og AS (SELECT *, CASE WHEN baseline = 0 AND dhs >= 1.9 THEN 1 WHEN dhs >= 0.3 AND (baseline = 0 OR ratio > 1.2) THEN 2
  WHEN dhs >= 0 AND (baseline = 0 OR ratio > 0.8) THEN 3 ELSE 4 END AS g0 FROM dh),
o2 AS (SELECT *, CASE WHEN g0 IN (1, 2) AND hits_all < 3 THEN 3 ELSE g0 END AS own FROM og),
o3 AS (SELECT *, max(own) FILTER (lang = 'en') OVER (PARTITION BY keyword) AS en_group FROM o2),
groups AS (SELECT *, CASE WHEN en_group IN (3, 4) THEN en_group ELSE own END AS g FROM o3),
ov AS (SELECT DISTINCT keyword, en_group AS g FROM groups),
akw AS (SELECT DISTINCT h.ad_id, h.year, h.occupation, h.keyword, ov.g FROM hits h JOIN ov USING (keyword))"""


@query(
    "keyword_counts_monthly",
    f"""{_R} SELECT h.year, h.month, h.bucket, h.keyword, count(*) AS n,
      any_value((SELECT count(*) FROM ads a WHERE a.year = h.year AND a.month = h.month)) AS month_total,
      any_value((SELECT count(*) FROM ads a WHERE a.year = h.year AND a.month = h.month AND a.language = h.bucket)) AS language_total,
      CAST(3 AS BIGINT) AS format_version FROM hits h GROUP BY ALL""",
)
def keyword_counts_monthly(spark, sf_dir):
    """Counted and kept; the second call finds the stored counts and does not match again."""
    path = new_path(spark, "kept-counts")
    tl.reusable_counts(_raw_matched(spark, sf_dir), path)
    return tl.reusable_counts(_raw_matched(spark, sf_dir), path)


@query(
    "dhs_groups",
    f"""{_DHS} SELECT keyword, lang, round(baseline, 6) AS baseline, round(slope, 6) AS slope, round(yp, 6) AS y_pred,
      y AS y_actual, round(ratio, 6) AS ratio, round(dhs, 6) AS dhs, CAST(own AS BIGINT) AS own_group,
      CAST(en_group AS BIGINT) AS en_group, CAST(g AS BIGINT) AS "group" FROM groups""",
)
def dhs_groups(spark, sf_dir):
    sigs = signatures(_raw_matched(spark, sf_dir), "year")
    return tl.dhs_groups(_dict(spark), keyword_counts(sigs, "year"), RULES).select(
        "keyword", "lang", "baseline", "slope", "y_pred", "y_actual", "ratio", "dhs", "own_group", "en_group", "group"
    )


_CO = """adn AS (SELECT ad_id, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 2) AS n2, count(*) FILTER (g = 3) AS n3
  FROM akw GROUP BY ad_id),
co AS (SELECT keyword, (n1 > 0 AND g <> 1) OR n1 > 1 AS c1, (n2 > 0 AND g <> 2) OR n2 > 1 AS c2,
  (n3 > 0 AND g <> 3) OR n3 > 1 AS c3 FROM akw JOIN adn USING (ad_id) WHERE year >= 2023),
rates AS (SELECT d.keyword, count(co.keyword) AS total, coalesce(avg(CAST(c1 AS INT)), 0) AS r1, coalesce(avg(CAST(c2 AS INT)), 0) AS r2,
  coalesce(avg(CAST(c3 AS INT)), 0) AS r3, coalesce(avg(CAST(c2 OR c3 AS INT)), 0) AS r23
  FROM dict d LEFT JOIN co ON co.keyword = d.keyword GROUP BY d.keyword)"""


@query(
    "cooccurrence_rates",
    f"""{_DHS}, {_CO} SELECT keyword, total, round(r1, 6) AS g1_rate, round(r2, 6) AS g2_rate, round(r3, 6) AS g3_rate,
      round(r23, 6) AS g2_g3_rate FROM rates""",
)
def cooccurrence_rates(spark, sf_dir):
    sigs = _raw_signatures(spark, sf_dir)
    return tl.cooccurrence_rates(sigs, _groups(spark, sigs), _dict(spark), RULES)


@query(
    "keyword_group_map",
    f"""{_DHS}, {_CO} SELECT keyword, CAST(max(en_group) AS BIGINT) AS "group", {", ".join(
        f"CAST(max(g) FILTER (lang = '{la}') AS BIGINT) AS group_{la}" for la in tl.RATED_LANGUAGES)},
      round(any_value(r1), 6) AS g1_rate, round(any_value(r2), 6) AS g2_rate, round(any_value(r3), 6) AS g3_rate,
      round(any_value(r23), 6) AS g2_g3_rate FROM groups JOIN rates USING (keyword) GROUP BY keyword""",
)
def keyword_group_map(spark, sf_dir):
    sigs = _raw_signatures(spark, sf_dir)
    groups = _groups(spark, sigs)
    return tl.keyword_group_map(groups, tl.cooccurrence_rates(sigs, groups, _dict(spark), RULES))


_INTENSE = """occ AS (SELECT a.occupation, count(*) AS total_ads,
    count(*) FILTER (a.ad_id IN (SELECT ad_id FROM akw WHERE g = 1)) AS g1_ads
  FROM ads a WHERE year = 2025 GROUP BY a.occupation),
oi AS (SELECT *, g1_ads / total_ads AS intensity, sum(g1_ads) OVER () AS tot FROM occ),
oc AS (SELECT *, sum(g1_ads) OVER (ORDER BY intensity DESC, occupation) AS cum FROM oi WHERE intensity >= 0.005),
dense_occ AS (SELECT * FROM oc WHERE cum - g1_ads < 0.8 * tot)"""


@query(
    "intensive_occupations",
    f"""{_DHS}, {_INTENSE} SELECT occupation, CAST(g1_ads AS BIGINT) AS g1_ads, total_ads, round(intensity, 6) AS intensity,
      round(cum / tot, 6) AS cumulative_coverage FROM dense_occ""",
)
def intensive_occupations(spark, sf_dir):
    sigs = _raw_signatures(spark, sf_dir)
    return tl.intensive_occupations(tl.occupation_intensity(sigs, _groups(spark, sigs), RULES), RULES)


_FLAGS = f"""{_DHS}, {_INTENSE}, lh AS (
  SELECT DISTINCT h.ad_id, h.keyword, coalesce(gr.g, 3) AS g FROM hits h
  LEFT JOIN groups gr ON gr.keyword = h.keyword AND gr.lang = h.bucket),
n AS (SELECT a.ad_id, a.year, count(DISTINCT lh.keyword) FILTER (g = 1) AS n1, count(DISTINCT lh.keyword) FILTER (g = 2) AS n2,
    count(DISTINCT lh.keyword) FILTER (g = 3) AS n3, coalesce(bool_or(lh.keyword = 'Copilot'), false) AS cp,
    any_value(a.occupation) IN (SELECT occupation FROM dense_occ) AS dense, any_value(a.text) AS text,
    coalesce(string_agg(DISTINCT lh.keyword, '|' ORDER BY lh.keyword), '') AS kws
  FROM ads a LEFT JOIN lh USING (ad_id) GROUP BY a.ad_id, a.year),
flags AS (SELECT *, n1 >= 1 AS r1, n2 >= 1 AND dense AS r2, n2 + n3 >= 3 AND n2 >= 1 AS r3,
    cp AND regexp_matches(replace(lower(text), 'schemas-thble', ''), '\\b(thble|attion)\\b') AS rc FROM n)"""


def _scored(spark, sf_dir) -> DataFrame:
    slim = _raw_matched(spark, sf_dir).select(
        "ad_id", "year", "occupation", "matches", F.col("text").rlike(tl.copilot_context("thble", "attion")).alias("makers")
    )
    slim = stage(slim, "matched")
    sigs = signatures(slim, "year", "occupation")
    groups = _groups(spark, sigs)
    dense = tl.intensive_occupations(tl.occupation_intensity(sigs, groups, RULES), RULES)
    return tl.flag_rules(slim, groups, dense, RULES, makers="makers")


@query(
    "flag_rules",
    f"""{_FLAGS} SELECT ad_id, kws AS matched_keywords, n1 AS g1_count, n2 AS g2_count, n3 AS g3_count, r1 AS flag_rule_1,
      r2 AS flag_rule_2, r3 AS flag_rule_3, rc AS flag_rule_copilot, r1 OR r2 OR r3 OR rc AS genai_flag FROM flags""",
)
def flag_rules(spark, sf_dir):
    out = _scored(spark, sf_dir)
    return out.select(
        "ad_id", F.array_join("matched_keywords", "|").alias("matched_keywords"), "g1_count", "g2_count",
        F.size("matched_g3_keywords").alias("g3_count"),
        "flag_rule_1", "flag_rule_2", "flag_rule_3", "flag_rule_copilot", "genai_flag",
    )


@query(
    "keyword_time_series",
    f"""{_FLAGS}, fa AS (SELECT *, r1 OR r2 OR r3 OR rc AS f FROM flags)
    SELECT keyword, fa.year, count(*) AS match_count, count(*) FILTER (f) AS flagged_count, count(*) FILTER (r1) AS flagged_g1,
      count(*) FILTER (r2 AND NOT r1) AS flagged_g2, count(*) FILTER (r3 AND NOT r1 AND NOT r2) AS flagged_g3,
      count(*) FILTER (rc AND NOT r1 AND NOT r2 AND NOT r3) AS flagged_rc
    FROM fa JOIN (SELECT DISTINCT ad_id, keyword FROM lh) k USING (ad_id) GROUP BY ALL""",
)
def keyword_time_series_query(spark, sf_dir):
    return keyword_time_series(_scored(spark, sf_dir))
