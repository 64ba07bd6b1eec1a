"""Common table expressions of the SQL twins. Patterns are written out by hand."""

ADS = """ads AS (
  SELECT doc_id AS ad_id, text, 2016 + doc_id % 10 AS year, 1 + (doc_id // 10) % 12 AS month,
         CASE WHEN lang = 'es' AND doc_id % 2 = 1 THEN 'it' ELSE lang END AS language,
         source AS occupation
  FROM documents)"""

NORM_EXPR = r"""trim(regexp_replace(regexp_replace(strip_accents(
  replace(replace(replace(replace(lower(text), 'ü', 'ue'), 'ö', 'oe'), 'ä', 'ae'), 'ß', 'ss')),
  '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"""

NORM = f"{ADS}, norm AS (SELECT *, {NORM_EXPR} AS n FROM ads)"

DICT = """dict0(keyword, grp, source, validated, en) AS (VALUES
  ('Late Signal', 1, 'St', true, 'reshst'), ('Ndtiea', 1, 'St', true, 'ndtiea'),
  ('Awhlyha', 1, 'H&L', true, 'awhlyha'), ('Thesated', 1, 'LLM', false, 'thesated'),
  ('Onwhin', 2, 'St', true, 'onwhin'), ('Attion', 2, 'St', true, 'attion to'),
  ('Tition', 2, 'St', true, 'Tition'), ('Atan', 2, 'H&L', true, 'atan'),
  ('Hest', 2, 'H&L', true, 'hest'), ('Eded', 2, 'LLM', false, 'eded'),
  ('Tion', 2, 'St', true, 'tion'), ('Tion-Of', 3, 'LLM', false, 'tion-of'),
  ('Anin', 2, 'LLM', false, 'anin'), ('Thble', 3, 'H&L', true, 'thble'),
  ('Thly', 3, 'LLM', false, 'thly'), ('Erhe', 3, 'LLM', false, 'erhe'),
  ('Of The', 3, 'H&L', true, 'of the'), ('Ones', 3, 'St', true, 'ones'),
  ('And Attion', 3, 'St', true, 'and attion to'), ('Eror', 3, 'H&L', true, 'eror'),
  ('Heou', 3, 'LLM', false, 'heou'), ('Ing', 3, 'LLM', false, 'ing'),
  ('Copilot', 2, 'St', true, 'heed'), ('Zzyzx Quux', 3, 'LLM', false, 'zzyzx quux')),
dict AS (SELECT keyword, CAST(grp AS BIGINT) AS grp, source, validated, en FROM dict0)"""

PATTERNS = """pats(keyword, bucket, pat) AS (VALUES
  ('Late Signal', 'en', 'reshsts?'), ('Late Signal', 'de', 'enstue'),
  ('Late Signal', 'fr', 'echens?'), ('Late Signal', 'it', 'gall'),
  ('Ndtiea', 'en', 'ndtieas?'),
  ('Awhlyha', 'en', 'awhlyhas?'), ('Awhlyha', 'de', 'enzuung'),
  ('Awhlyha', 'fr', 'reeuxchs?'), ('Awhlyha', 'it', 'tata'),
  ('Thesated', 'en', 'thesateds?'),
  ('Onwhin', 'en', 'onwhins?'), ('Onwhin', 'de', 'teeiner'),
  ('Onwhin', 'fr', 'leequees?'), ('Onwhin', 'it', 'osiell'),
  ('Attion', 'en', 'attion tos?'), ('Attion', 'de', 'sch der'),
  ('Attion', 'fr', 'de la'), ('Attion', 'it', 'rancion arar'),
  ('Tition', 'en', 'titions?'), ('Tition', 'de', 'ungen|heiten'),
  ('Tition', 'fr', 'auxs?'), ('Tition', 'it', 'nque'),
  ('Atan', 'en', 'atans?'), ('Atan', 'de', 'nicht'), ('Atan', 'fr', 'quis?'), ('Atan', 'it', 'raie'),
  ('Hest', 'en', 'hests?'), ('Hest', 'de', 'fuer'), ('Hest', 'fr', 'eiers?'), ('Hest', 'it', 'esra'),
  ('Eded', 'en', 'ededs?'), ('Eded', 'de', 'sich|zur'), ('Eded', 'fr', 'ements?'), ('Eded', 'it', 'oses'),
  ('Tion', 'en', 'tions?'), ('Tion', 'de', 'enheit'), ('Tion', 'it', 'cion'),
  ('Tion-Of', 'en', 'tion ofs?'), ('Tion-Of', 'de', 'der des'),
  ('Tion-Of', 'fr', 'la tion'), ('Tion-Of', 'it', 'de cion'),
  ('Anin', 'en', 'anins?'), ('Anin', 'de', 'ente'), ('Anin', 'fr', 'enments?'), ('Anin', 'it', 'que de'),
  ('Thble', 'en', 'thbles?'), ('Thble', 'de', 'erung'), ('Thble', 'fr', 'ouons?'), ('Thble', 'it', 'esja'),
  ('Thly', 'en', 'thlys?'), ('Thly', 'de', 'chein'), ('Thly', 'fr', 'oiques?'), ('Thly', 'it', 'jaado'),
  ('Erhe', 'en', 'erhes?'), ('Erhe', 'de', 'enge'), ('Erhe', 'fr', 'enchs?'), ('Erhe', 'it', 'rancion'),
  ('Of The', 'en', 'of thes?'), ('Of The', 'de', 'von der'),
  ('Of The', 'fr', 'la des'), ('Of The', 'it', 'la de'),
  ('Ones', 'en', 'ones'), ('Ones', 'de', 'heit'), ('Ones', 'fr', 'eauxs?'), ('Ones', 'it', 'los de'),
  ('And Attion', 'en', 'and attion tos?'), ('And Attion', 'de', 'enau sch der'),
  ('And Attion', 'fr', 'et de la'), ('And Attion', 'it', 'el de'),
  ('Eror', 'en', 'erors?'), ('Eror', 'de', 'erpf'), ('Eror', 'fr', 'aipas?'), ('Eror', 'it', 'esado|asmente'),
  ('Heou', 'en', 'heous?'), ('Heou', 'de', 'geer'), ('Heou', 'fr', 'eetions?'), ('Heou', 'it', 'domi'),
  ('Ing', 'en', 'ings?'), ('Ing', 'de', 'zur'), ('Ing', 'fr', 'ouis?'), ('Ing', 'it', 'cos'),
  ('Copilot', 'en', 'heeds?'), ('Copilot', 'de', 'einbe'), ('Copilot', 'fr', 'ouvis?'), ('Copilot', 'it', 'osar'),
  ('Zzyzx Quux', 'en', 'zzyzx quuxs?'), ('Zzyzx Quux', 'de', 'zzyzx quuxe'),
  ('Zzyzx Quux', 'fr', 'zzyzxs? quuxas?'), ('Zzyzx Quux', 'it', 'zzyzx quuxo'))"""

HITS = rf"""{NORM}, {DICT}, {PATTERNS}, hits AS (
  SELECT a.ad_id, a.language, a.year, a.month, a.occupation, p.bucket, p.keyword, d.grp
  FROM norm a JOIN pats p ON p.bucket = 'en' OR p.bucket = a.language
  JOIN dict d ON d.keyword = p.keyword
  WHERE regexp_matches(a.n, '\b(' || p.pat || ')\b'))"""

CLASSIFIED = f"""{HITS}, best AS (SELECT ad_id, min(grp) AS g FROM hits GROUP BY ad_id),
classified AS (
  SELECT a.ad_id, a.language, a.year, a.month, a.text, coalesce(CAST(b.g AS VARCHAR), 'NA') AS grp
  FROM ads a LEFT JOIN best b USING (ad_id)),
triggers AS (
  SELECT DISTINCT h.ad_id, h.keyword, CAST(b.g AS VARCHAR) AS grp
  FROM hits h JOIN best b ON b.ad_id = h.ad_id AND b.g = h.grp)"""

KW_COUNTS = """akw AS (SELECT DISTINCT ad_id, keyword, grp FROM hits),
percount AS (
  SELECT ad_id, count(*) FILTER (grp = 1) AS g1, count(*) FILTER (grp = 2) AS g2,
         count(*) FILTER (grp = 3) AS g3, count(*) FILTER (grp > 1) AS g23,
         3 * count(*) FILTER (grp = 1) + 2 * count(*) FILTER (grp = 2) + count(*) FILTER (grp = 3) AS score
  FROM akw GROUP BY ad_id)"""

TREND = """langs(lang, rk) AS (VALUES ('en', 1), ('de', 2), ('fr', 3), ('it', 4)),
yc AS (SELECT year, bucket AS lang, keyword, count(*) AS n FROM hits GROUP BY ALL),
dense AS (
  SELECT d.keyword, l.lang, l.rk, y.y AS year, coalesce(yc.n, 0) AS n
  FROM {kws} d CROSS JOIN langs l CROSS JOIN (SELECT unnest(range(2016, 2026)) AS y) y
  LEFT JOIN yc ON yc.keyword = d.keyword AND yc.lang = l.lang AND yc.year = y.y),
fit AS (
  SELECT keyword, lang, rk,
         regr_slope(n, year - 2016) FILTER (year <= 2020) AS slope,
         regr_intercept(n, year - 2016) FILTER (year <= 2020) AS intercept,
         avg(n) FILTER (year <= 2020) AS mean,
         CAST(sum(n) FILTER (year <= 2020) AS BIGINT) AS pre_total,
         CAST(sum(n) FILTER (year >= 2023) AS BIGINT) AS recent_total,
         CAST(sum(n) FILTER (year = 2025) AS BIGINT) AS y_val
  FROM dense GROUP BY keyword, lang, rk),
trend AS (
  SELECT *, intercept + 9 * slope AS yhat,
         round(greatest(intercept + 9 * slope, mean, 0), 9) AS b FROM fit),
g1 AS (
  SELECT keyword, CAST(sum(pre_total) AS BIGINT) AS pre_total, CAST(sum(recent_total) AS BIGINT) AS recent_total,
         CAST(sum(y_val) AS BIGINT) AS y_val_all_langs, sum(pre_total) = 0 AS zero_pre,
         sum(pre_total) = 0 AND sum(recent_total) >= 1 AS is_g1
  FROM trend GROUP BY keyword),
cs(c) AS (VALUES (0.0::DOUBLE), (1.05), (1.1), (1.5), (3.0), (5.0)),
ks(k) AS (SELECT unnest(range(1, 6))),
g2 AS (
  SELECT DISTINCT cs.c, t.keyword FROM trend t JOIN g1 USING (keyword) CROSS JOIN cs
  WHERE NOT g1.is_g1 AND t.y_val >= cs.c * t.b AND t.y_val >= 10),
kwad AS (
  SELECT DISTINCT h.ad_id, h.keyword FROM hits h JOIN g1 USING (keyword) WHERE h.year = 2025),
adc AS (
  SELECT ad_id, cs.c, count(*) FILTER (g1.is_g1) AS n1, count(g2.keyword) AS n2
  FROM kwad JOIN g1 USING (keyword) CROSS JOIN cs
  LEFT JOIN g2 ON g2.keyword = kwad.keyword AND g2.c = cs.c GROUP BY ad_id, cs.c)"""

POSTS = """posts AS (
  SELECT o_orderkey AS id, o_custkey AS firm_id, c_name AS company_name, c_mktsegment AS seg,
         o_orderdate AS created, year(o_orderdate) AS year, c_nationkey AS nation,
         o_orderpriority AS priority, o_orderstatus AS status,
         CASE o_orderpriority WHEN '1-URGENT' THEN '1' WHEN '2-HIGH' THEN '2' WHEN '3-MEDIUM' THEN '3'
              ELSE 'NA' END AS grp,
         o_orderpriority = '1-URGENT' AS flag
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""

LINES = """lines AS (
  SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_partkey % 41 <> 0 THEN l_partkey END AS k,
         l_shipdate AS created, year(l_shipdate) AS year, l_returnflag FROM lineitem)"""
