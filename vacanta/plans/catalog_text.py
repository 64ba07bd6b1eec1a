"""Registered queries: normalisation, matching, classification, combination strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta.functions.text import normalize
from vacanta.operators import strategies as st
from vacanta.operators.dictionary import dictionary_frame
from vacanta.operators.match import (
    forms_table,
    match_by_join,
    candidates,
    classify_group,
    keywords,
    match_keywords,
    match_longest_first,
    passes_prefilter,
    signatures,
    simple_score,
)
from vacanta.operators.prepare import allow_languages
from vacanta.operators.reports import keyword_coverage, keyword_volume, language_mix, supported_languages, top_keywords
from vacanta.operators.screening import class_counts, false_positive_screen, sample_per_group
from vacanta.plans import sql
from vacanta.plans.registry import query
from vacanta.plans.views import TEST_DICTIONARY, ads


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_keywords(ads(spark, sf_dir), TEST_DICTIONARY)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_group(matched(spark, sf_dir))


def _joined(column: str):
    return F.array_join(column, "|")


@query("normalize_text", f"WITH {sql.NORM} SELECT ad_id, md5(n) AS norm_md5, length(n) AS n_chars FROM norm")
def normalize_text(spark, sf_dir):
    out = ads(spark, sf_dir).select("ad_id", normalize(F.col("text")).alias("n"))
    return out.select("ad_id", F.md5("n").alias("norm_md5"), F.length("n").alias("n_chars"))


@query(
    "keyword_match",
    f"WITH {sql.HITS} SELECT ad_id, string_agg(DISTINCT keyword, '|' ORDER BY keyword) AS kws FROM hits GROUP BY ad_id",
)
def keyword_match(spark, sf_dir):
    out = matched(spark, sf_dir).where(F.size("matches") > 0)
    return out.select("ad_id", _joined(keywords()).alias("kws"))


@query(
    "keyword_match_by_join",
    f"""WITH {sql.HITS}, k AS (SELECT ad_id, string_agg(DISTINCT keyword, '|' ORDER BY keyword) AS kws FROM hits GROUP BY ad_id)
    SELECT CASE WHEN a.ad_id % 10 = 0 THEN -1 ELSE a.ad_id // 2 END AS id, coalesce(kws, '') AS kws, count(*) AS n
    FROM ads a LEFT JOIN k USING (ad_id) GROUP BY ALL""",
)
def keyword_match_by_join(spark, sf_dir):
    """The join way with ids that are missing or repeated."""
    rows = ads(spark, sf_dir).withColumn("ad_id", F.when(F.col("ad_id") % 10 != 0, F.floor(F.col("ad_id") / 2)))
    out = match_by_join(rows, forms_table(spark, TEST_DICTIONARY))
    return out.groupBy(F.coalesce("ad_id", F.lit(-1)).alias("id"), _joined(keywords()).alias("kws")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "keyword_match_by_bucket",
    f"""WITH {sql.HITS} SELECT ad_id, bucket, string_agg(DISTINCT keyword, '|' ORDER BY keyword) AS kws
    FROM hits GROUP BY ad_id, bucket""",
)
def keyword_match_by_bucket(spark, sf_dir):
    hits = matched(spark, sf_dir).select("ad_id", "matches", F.explode(F.array_distinct("matches.bucket")).alias("bucket"))
    kws = keywords(F.expr("filter(matches, m -> m.bucket = bucket)"))
    return hits.select("ad_id", "bucket", _joined(kws).alias("kws"))


@query(
    "plural_match",
    rf"""WITH {sql.NORM}, p(label, lang, pat) AS (VALUES
      ('and', 'en', 'ands?'), ('the tion', 'en', 'the tions?'), ('re', 'en', 're|res'),
      ('is', 'en', 'is'), ('de la', 'fr', 'de la'), ('re', 'fr', 're|res'), ('le pa', 'fr', 'le pa'),
      ('ment tre', 'fr', '(ment|ments) (tre|tres)'), ('tz', 'de', 'tz|ung'), ('ado', 'it', 'ado|ez'))
    SELECT p.label, p.lang, count(*) AS n_ads FROM norm a JOIN p ON p.lang = a.language
    WHERE regexp_matches(a.n, '\b(' || pat || ')\b') GROUP BY ALL""",
)
def plural_match(spark, sf_dir):
    from vacanta.functions.patterns import Dictionary, Keyword

    def kw(name, lang):
        forms = {"en": name} if lang == "en" else {"en": "", lang: name}
        return Keyword(f"{lang}:{name}", 1, "St", forms)

    words = Dictionary(
        (kw("and", "en"), kw("the tion", "en"), kw("re", "en"), kw("is", "en"), kw("de la", "fr"),
         kw("re", "fr"), kw("le pa", "fr"), kw("ment tre", "fr"), kw("tz", "de"), kw("ado", "it")),
        extra_forms={"de": {"de:tz": ("Ung",)}, "it": {"it:ado": ("ez",)}},
    )
    hits = match_keywords(ads(spark, sf_dir), words).select("language", F.explode("matches.keyword").alias("kw"))
    parts = F.split("kw", ":")
    return (
        hits.select("language", parts[0].alias("lang"), parts[1].alias("label"))
        .where("lang = language")
        .groupBy("label", "lang")
        .agg(F.count(F.lit(1)).alias("n_ads"))
    )


# The SQL twin has no look-around: word gaps are doubled so that neighbouring hits can each use one.
_RAW_EN = (
    "and[\\s-]+attion[\\s-]+to|zzyzx[\\s-]+quux|attion[\\s-]+to|thesated|awhlyha|tion[\\s-]+of|reshst|ndtiea|onwhin|"
    "tition|of[\\s-]+the|thble|atan|hest|eded|tion|anin|thly|erhe|ones|eror|heou|heed|ing"
)
_RAW_LOCAL = {
    "de": "zzyzx[\\s-]+quuxe|enau[\\s-]+sch[\\s-]+der|enzuung|teeiner|sch[\\s-]+der|der[\\s-]+des|von[\\s-]+der|enstue|"
    "enheit|ungen|nicht|erung|chein|einbe|sich|ente|enge|heit|erpf|geer|für|zur",
    "fr": "zzyzx[\\s-]+quuxa|et[\\s-]+de[\\s-]+la|reeuxch|leequee|la[\\s-]+tion|eetion|enment|la[\\s-]+des|echen|"
    "de[\\s-]+la|oique|èment|éier|ouon|ench|eaux|aipa|ouvi|aux|qui|oui",
    "it": "zzyzx[\\s-]+quuxo|rancion[\\s-]+arar|de[\\s-]+ción|rancion|osiell|que[\\s-]+de|los[\\s-]+de|la[\\s-]+de|"
    "el[\\s-]+de|jaado|esado|gall|tata|nque|raie|esra|oses|ción|esja|domi|osar|cos",
}
_EDGE = "[^\\p{L}\\p{N}_]"


def _raw_extract(pattern: str) -> str:
    return f"regexp_extract_all(t2, '(?i)(?:^|{_EDGE})({pattern})(?:{_EDGE}|$)', 1)"


RAW_FORMS = """forms(form, bucket, keyword) AS (VALUES
  ('and attion to','en','And Attion'),('zzyzx quux','en','Zzyzx Quux'),('attion to','en','Attion'),
  ('thesated','en','Thesated'),('awhlyha','en','Awhlyha'),('tion of','en','Tion-Of'),('reshst','en','Late Signal'),
  ('ndtiea','en','Ndtiea'),('onwhin','en','Onwhin'),('tition','en','Tition'),('of the','en','Of The'),
  ('thble','en','Thble'),('atan','en','Atan'),('hest','en','Hest'),('eded','en','Eded'),('tion','en','Tion'),
  ('anin','en','Anin'),('thly','en','Thly'),('erhe','en','Erhe'),('ones','en','Ones'),('eror','en','Eror'),
  ('heou','en','Heou'),('heed','en','Copilot'),('ing','en','Ing'),
  ('zzyzx quuxe','de','Zzyzx Quux'),('enau sch der','de','And Attion'),('enzuung','de','Awhlyha'),
  ('teeiner','de','Onwhin'),('sch der','de','Attion'),('der des','de','Tion-Of'),('von der','de','Of The'),
  ('enstue','de','Late Signal'),('enheit','de','Tion'),('ungen','de','Tition'),('nicht','de','Atan'),
  ('erung','de','Thble'),('chein','de','Thly'),('einbe','de','Copilot'),('sich','de','Eded'),('ente','de','Anin'),
  ('enge','de','Erhe'),('heit','de','Ones'),('erpf','de','Eror'),('geer','de','Heou'),('für','de','Hest'),('zur','de','Ing'),
  ('zzyzx quuxa','fr','Zzyzx Quux'),('et de la','fr','And Attion'),('reeuxch','fr','Awhlyha'),('leequee','fr','Onwhin'),
  ('la tion','fr','Tion-Of'),('eetion','fr','Heou'),('enment','fr','Anin'),('la des','fr','Of The'),
  ('echen','fr','Late Signal'),('de la','fr','Attion'),('oique','fr','Thly'),('èment','fr','Eded'),('éier','fr','Hest'),
  ('ouon','fr','Thble'),('ench','fr','Erhe'),('eaux','fr','Ones'),('aipa','fr','Eror'),('ouvi','fr','Copilot'),
  ('aux','fr','Tition'),('qui','fr','Atan'),('oui','fr','Ing'),
  ('zzyzx quuxo','it','Zzyzx Quux'),('rancion arar','it','Attion'),('de ción','it','Tion-Of'),('rancion','it','Erhe'),
  ('osiell','it','Onwhin'),('que de','it','Anin'),('los de','it','Ones'),('la de','it','Of The'),('el de','it','And Attion'),
  ('jaado','it','Thly'),('esado','it','Eror'),('gall','it','Late Signal'),('tata','it','Awhlyha'),('nque','it','Tition'),
  ('raie','it','Atan'),('esra','it','Hest'),('oses','it','Eded'),('ción','it','Tion'),('esja','it','Thble'),
  ('domi','it','Heou'),('osar','it','Copilot'),('cos','it','Ing'))"""

# Literals of four and more characters, with hyphens for spaces; shorter ones do not count.
_LITERALS = (
    "late[ -]signal|ndtiea|awhlyha|thesated|onwhin|attion|tition|atan|hest|eded|tion|anin|thble|thly|erhe|of the|of-the|"
    "ones|and attion|eror|heou|copilot|heed|zzyzx|reshst|enstue|enzuung|teeiner|sch der|sch-der|ungen|nicht|sich|enheit|"
    "der des|der-des|ente|erung|chein|enge|von der|von-der|heit|erpf|geer|einbe|echen|gall|reeuxch|tata|leequee|osiell|"
    "de la|de-la|rancion|nque|raie|éier|esra|èment|oses|la tion|la-tion|ción|enment|que de|que-de|ouon|esja|oique|jaado|"
    "ench|la de|la-de|eaux|los de|los-de|el de|el-de|aipa|esado|eetion|domi|ouvi|osar"
)

RAW_HITS = f"""{sql.ADS}, {sql.DICT}, {RAW_FORMS}, wide AS (
  SELECT *, regexp_replace(text, '({_EDGE})', '\\1\\1', 'g') AS t2,
         regexp_matches(lower(text), '{_LITERALS}') AS pre FROM ads),
found AS (
  SELECT *, unnest({_raw_extract(_RAW_EN)}) AS s, 'en' AS bucket FROM wide
  UNION ALL SELECT *, unnest({_raw_extract(_RAW_LOCAL["de"])}), 'de' FROM wide WHERE language = 'de'
  UNION ALL SELECT *, unnest({_raw_extract(_RAW_LOCAL["fr"])}), 'fr' FROM wide WHERE language = 'fr'
  UNION ALL SELECT *, unnest({_raw_extract(_RAW_LOCAL["it"])}), 'it' FROM wide WHERE language = 'it'),
rhits AS (
  SELECT DISTINCT f.ad_id, f.language, f.year, f.month, f.occupation, f.pre, f.bucket, m.keyword
  FROM found f JOIN forms m ON m.bucket = f.bucket AND m.form = regexp_replace(lower(f.s), '[\\s-]+', ' ', 'g'))"""


@query(
    "keyword_match_longest_first",
    f"""WITH {RAW_HITS} SELECT ad_id, bucket, string_agg(keyword, '|' ORDER BY keyword) AS kws
    FROM rhits GROUP BY ad_id, bucket""",
)
def keyword_match_longest_first(spark, sf_dir):
    out = match_longest_first(ads(spark, sf_dir), TEST_DICTIONARY, prefilter=False)
    hits = out.select("ad_id", "matches", F.explode(F.array_distinct("matches.bucket")).alias("bucket"))
    kws = keywords(F.expr("filter(matches, m -> m.bucket = bucket)"))
    return hits.select("ad_id", "bucket", _joined(kws).alias("kws"))


@query(
    "literal_prefilter",
    f"""WITH {RAW_HITS} SELECT w.language, count(*) AS n_ads, count(*) FILTER (w.pre) AS n_pass,
      count(*) FILTER (h.ad_id IS NOT NULL) AS n_any, count(*) FILTER (w.pre AND h.ad_id IS NOT NULL) AS n_scored
    FROM wide w LEFT JOIN (SELECT DISTINCT ad_id FROM rhits) h USING (ad_id) GROUP BY w.language""",
)
def literal_prefilter(spark, sf_dir):
    out = match_longest_first(ads(spark, sf_dir), TEST_DICTIONARY, prefilter=False)
    out = out.select("language", "matches", passes_prefilter(F.col("text"), TEST_DICTIONARY).alias("pre"))
    hit = F.size("matches") > 0
    return out.groupBy("language").agg(
        F.count(F.lit(1)).alias("n_ads"),
        F.count_if("pre").alias("n_pass"),
        F.count_if(hit).alias("n_any"),
        F.count_if(F.col("pre") & hit).alias("n_scored"),
    )


@query(
    "simple_score",
    f"""WITH {RAW_HITS}, s AS (SELECT a.ad_id, a.year, count(DISTINCT h.keyword) AS score FROM ads a
      LEFT JOIN rhits h ON h.ad_id = a.ad_id AND h.pre GROUP BY ALL)
    SELECT year, score AS genai_score, score > 0 AS genai_flag, count(*) AS n FROM s GROUP BY ALL""",
)
def simple_score_query(spark, sf_dir):
    scored = simple_score(match_longest_first(ads(spark, sf_dir), TEST_DICTIONARY))
    return scored.groupBy("year", "genai_score", "genai_flag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "classify_group",
    f"""WITH {sql.CLASSIFIED} SELECT c.ad_id, c.grp AS "group", coalesce(t.kws, '') AS trigger_keywords
    FROM classified c LEFT JOIN (SELECT ad_id, string_agg(keyword, '|' ORDER BY keyword) AS kws
      FROM triggers GROUP BY ad_id) t USING (ad_id)""",
)
def classify_group_query(spark, sf_dir):
    out = classified(spark, sf_dir)
    return out.select("ad_id", "group", _joined("matched_group_keywords").alias("trigger_keywords"))


@query(
    "class_counts",
    f"""WITH {sql.CLASSIFIED} SELECT grp AS "group", count(*) AS n,
      round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM classified GROUP BY grp""",
)
def class_counts_query(spark, sf_dir):
    return class_counts(classified(spark, sf_dir))


@query(
    "candidate_population",
    rf"""WITH {sql.CLASSIFIED} SELECT year, count(*) AS n_candidates, count(*) FILTER (grp = 'NA') AS n_extra
    FROM classified WHERE grp <> 'NA' OR regexp_matches(lower(text), '\bed(st)?\b|hehe') GROUP BY year""",
)
def candidate_population(spark, sf_dir):
    out = candidates(classified(spark, sf_dir), r"\bed(st)?\b|hehe")
    return out.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if(F.col("group") == "NA").alias("n_extra")
    )


@query(
    "language_allowlist",
    f"""WITH {sql.ADS} SELECT language AS detected_language, count(*) AS n FROM ads
    WHERE language IN ('de', 'fr', 'it', 'rm', 'en') GROUP BY language""",
)
def language_allowlist(spark, sf_dir):
    kept = allow_languages(ads(spark, sf_dir), ("de", "fr", "it", "rm", "en"))
    return kept.groupBy("detected_language").agg(F.count(F.lit(1)).alias("n"))


@query(
    "supported_languages",
    f"""WITH {sql.ADS} SELECT language, count(*) AS n FROM ads WHERE language <> 'unknown'
    GROUP BY language HAVING count(*) > 100""",
)
def supported_languages_query(spark, sf_dir):
    return supported_languages(ads(spark, sf_dir))


@query(
    "language_mix",
    f"""WITH {sql.CLASSIFIED}, s AS (
      SELECT language, 'All postings' AS scope, count(*) AS n FROM classified GROUP BY ALL
      UNION ALL SELECT language, 'Flagged postings', count(*) FROM classified WHERE grp <> 'NA' GROUP BY ALL)
    SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY scope), 6) AS share FROM s""",
)
def language_mix_query(spark, sf_dir):
    return language_mix(classified(spark, sf_dir))


_COUNTS = f"WITH {sql.HITS}, {sql.KW_COUNTS}"


def _counts(spark, sf_dir) -> DataFrame:
    """Group counts per match signature, weighted by the ads behind it."""
    sigs = classify_group(signatures(matched(spark, sf_dir)))
    return st.strategy_counts(sigs)


@query(
    "strategy_counts",
    f"""{_COUNTS} SELECT ad_id, g1 AS g1_count, g2 AS g2_count, g3 AS g3_count,
      coalesce((SELECT string_agg(keyword, ';' ORDER BY keyword) FROM akw WHERE akw.ad_id = p.ad_id AND grp = 2), '') AS g2_kw,
      coalesce((SELECT string_agg(keyword, ';' ORDER BY keyword) FROM akw WHERE akw.ad_id = p.ad_id AND grp = 3), '') AS g3_kw,
      ad_id % 11 = 0 AND g1 = 0 AS disagrees FROM percount p""",
)
def strategy_counts(spark, sf_dir):
    # Every eleventh grouped ad has group 1 stored, whatever its matches say.
    wrong = (F.col("group") != "NA") & (F.col("ad_id") % 11 == 0)
    stored = classified(spark, sf_dir).withColumn("group", F.when(wrong, "1").otherwise(F.col("group")))
    out = st.strategy_counts(stored)
    return out.select(
        "ad_id", "g1_count", "g2_count", "g3_count",
        F.array_join("g2_kw", ";").alias("g2_kw"), F.array_join("g3_kw", ";").alias("g3_kw"), "disagrees",
    )


@query(
    "strategy_option_a",
    f"""{_COUNTS} SELECT count(*) AS population, count(*) FILTER (g1 >= 1) AS high_confidence,
      count(*) FILTER (g23 >= 1) AS possible_raw, count(*) FILTER (g23 >= 1 AND g1 = 0) AS possible_only,
      count(*) FILTER (g23 >= 1 AND g1 >= 1) AS overlap FROM percount""",
)
def strategy_option_a(spark, sf_dir):
    return st.option_a(_counts(spark, sf_dir), "n_ads")


@query(
    "strategy_option_b",
    f"""{_COUNTS} SELECT k, count(*) FILTER (g1 >= 1 OR g23 >= k) AS total_flagged,
      count(*) FILTER (g1 = 0 AND g23 >= k) AS newly_flagged
    FROM percount CROSS JOIN (SELECT unnest(range(1, 7)) AS k) GROUP BY k""",
)
def strategy_option_b(spark, sf_dir):
    return st.option_b(_counts(spark, sf_dir), (1, *st.CORROBORATION_KS), "n_ads")


@query(
    "strategy_option_c",
    f"""{_COUNTS} SELECT cutoff, count(*) FILTER (score >= cutoff) AS total_flagged,
      count(*) FILTER (g1 = 0 AND score >= cutoff) AS newly_flagged
    FROM percount CROSS JOIN (SELECT unnest(range(3, 7)) AS cutoff) GROUP BY cutoff""",
)
def strategy_option_c(spark, sf_dir):
    return st.option_c(_counts(spark, sf_dir), weight="n_ads")


@query(
    "strategy_overlap",
    f"""{_COUNTS}, f AS (SELECT g1 >= 1 AS a, g1 >= 1 OR g23 >= 2 AS b, score >= 4 AS c FROM percount)
    SELECT count(*) FILTER (a AND NOT b AND NOT c) AS a_only, count(*) FILTER (NOT a AND b AND NOT c) AS b_only,
      count(*) FILTER (NOT a AND NOT b AND c) AS c_only, count(*) FILTER (a OR b OR c) AS any_flag,
      count(*) FILTER (a AND b AND c) AS all_flags, count(*) FILTER (b = c) AS b_c_agree,
      count(*) AS population FROM f""",
)
def strategy_overlap(spark, sf_dir):
    return st.overlap(_counts(spark, sf_dir), weight="n_ads")


@query(
    "newly_flagged_drivers",
    f"""{_COUNTS}, fresh AS (
      SELECT 'B@2' AS strategy, ad_id FROM percount WHERE g1 = 0 AND g23 >= 2
      UNION ALL SELECT 'C@4', ad_id FROM percount WHERE g1 = 0 AND score >= 4),
    tot AS (SELECT strategy, count(*) AS t FROM fresh GROUP BY strategy),
    d AS (SELECT strategy, keyword, count(*) AS n_ads FROM fresh JOIN akw USING (ad_id) WHERE grp IN (2, 3) GROUP BY ALL)
    SELECT strategy, keyword, n_ads, round(n_ads / t, 6) AS share,
      n_ads / t > 0.5 AND n_ads = max(n_ads) OVER (PARTITION BY strategy) AS dominant
    FROM d JOIN tot USING (strategy)""",
)
def newly_flagged_drivers(spark, sf_dir):
    from vacanta.sources.staging import stage

    sigs = stage(signatures(matched(spark, sf_dir)), "signatures")
    counts = st.strategy_counts(classify_group(sigs))
    b = st.newly_flagged_drivers(counts, st.corroborated(2), "n_ads").withColumn("strategy", F.lit("B@2"))
    c = st.newly_flagged_drivers(counts, st.score() >= 4, "n_ads").withColumn("strategy", F.lit("C@4"))
    return b.unionByName(c)


@query(
    "top_keywords",
    f"""WITH {sql.CLASSIFIED} SELECT keyword, grp AS "group", count(*) AS n_postings FROM triggers
    GROUP BY ALL ORDER BY n_postings DESC, keyword, grp LIMIT 25""",
)
def top_keywords_query(spark, sf_dir):
    return top_keywords(classified(spark, sf_dir))


_VOLUME = f"""WITH {sql.CLASSIFIED}, vol AS (
  SELECT d.keyword, d.grp, d.source, d.validated, count(t.ad_id) AS n
  FROM dict d LEFT JOIN triggers t ON t.keyword = d.keyword GROUP BY ALL)"""


def _volume(spark, sf_dir, validated=None) -> DataFrame:
    return keyword_volume(classified(spark, sf_dir), dictionary_frame(spark, TEST_DICTIONARY), validated)


@query("keyword_coverage", f'{_VOLUME} SELECT keyword, grp AS "group", source, n AS ad_match_count FROM vol')
def keyword_coverage_query(spark, sf_dir):
    return _volume(spark, sf_dir).select("keyword", "group", "source", "ad_match_count")


@query(
    "keyword_coverage_cube",
    f"""{_VOLUME} SELECT grp AS "group", source, count(*) FILTER (n > 0) AS matched, count(*) AS total
    FROM vol GROUP BY CUBE (grp, source)""",
)
def keyword_coverage_cube(spark, sf_dir):
    return keyword_coverage(_volume(spark, sf_dir), "group", "source")


@query(
    "keyword_volume",
    f"""{_VOLUME} SELECT validated, keyword, grp AS "group", n AS ad_match_count FROM vol WHERE n > 0""",
)
def keyword_volume_query(spark, sf_dir):
    vol = _volume(spark, sf_dir)
    return vol.where("ad_match_count > 0").select("validated", "keyword", "group", "ad_match_count")


@query(
    "false_positive_screen",
    f"""{_VOLUME}, s AS (SELECT *, round(100.0 * n / sum(n) OVER (), 6) AS share_pct FROM vol),
    r AS (SELECT *, CASE WHEN keyword IN ('Thly', 'Ing') THEN 'generic term'
        WHEN keyword = 'Tion-Of' THEN 'ambiguous term' WHEN n > 0 AND share_pct > 2 THEN 'high volume' END AS reason
      FROM s WHERE NOT validated)
    SELECT keyword, grp AS "group", n AS ad_match_count, share_pct, reason FROM r WHERE reason IS NOT NULL""",
)
def false_positive_screen_query(spark, sf_dir):
    return false_positive_screen(_volume(spark, sf_dir), ("Thly", "Ing"), ("Tion-Of",))


@query(
    "sample_per_group",
    rf"""WITH {sql.CLASSIFIED}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5(ad_id || ':42'), ad_id) AS rn
      FROM classified WHERE grp <> 'NA'),
    s AS (SELECT *, replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10), ' ') AS flat FROM r WHERE rn <= 5)
    SELECT ad_id, grp AS "group", language,
      (SELECT string_agg(keyword, '|' ORDER BY keyword) FROM triggers t WHERE t.ad_id = s.ad_id) AS kws,
      CASE WHEN length(flat) > 300 THEN substr(flat, 1, 300) || '...' ELSE flat END AS preview FROM s""",
)
def sample_per_group_query(spark, sf_dir):
    out = classified(spark, sf_dir).where(F.col("group") != "NA")
    sample = sample_per_group(out, "group", "ad_id", 5, text="text")
    return sample.select("ad_id", "group", "language", _joined("matched_group_keywords").alias("kws"), "preview")
