"""Registered queries: reports over postings, screening, crosswalks, regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacanta.operators import reports as rp
from vacanta.operators.crosswalk import many_to_many, occupation_share, rolled_up, two_hop, unmatched_rate
from vacanta.operators.dedup import dedup_within_year, duplicate_diagnostics, keep_first
from vacanta.operators.prepare import drop_ambiguous, drop_ambiguous_ids, drop_secondary_tag, half_open
from vacanta.operators.regression import share_exposure_ols, top_bottom
from vacanta.operators.screening import (
    drop_outlier_firm_years,
    flag_diagnostics,
    outlier_firm_years,
    three_valued,
)
from vacanta.plans import sql
from vacanta.plans.registry import query
from vacanta.plans.views import lines_dated, postings, table

_P = f"WITH {sql.POSTS}"


def _is_flagged() -> Column:
    return F.col("group") != "NA"


@query(
    "firm_level",
    f"""{_P} SELECT firm_id, arg_min(company_name, id) AS company_name, arg_min(seg, id) AS size_category,
      count(*) AS total_postings, count(*) FILTER (flag) AS genai_postings, count(*) FILTER (grp = '1') AS group1_count,
      count(*) FILTER (grp = '2') AS group2_count, round(count(*) FILTER (flag) / count(*), 6) AS genai_rate
    FROM posts GROUP BY firm_id""",
)
def firm_level(spark, sf_dir):
    return rp.firm_level(postings(spark, sf_dir))


_SHARE = "count(*) AS total_postings, count(*) FILTER (flag) AS genai_postings, round(100.0 * count(*) FILTER (flag) / count(*), 6) AS genai_percentage"


@query("time_series", f"{_P} SELECT year, {_SHARE} FROM posts GROUP BY year")
def time_series(spark, sf_dir):
    return rp.share_of(postings(spark, sf_dir), "year")


@query("industry_level", f"{_P} SELECT seg AS industry, {_SHARE} FROM posts GROUP BY seg")
def industry_level(spark, sf_dir):
    return rp.share_of(postings(spark, sf_dir), "industry")


@query("industry_time_series", f"{_P} SELECT seg AS industry, year, {_SHARE} FROM posts GROUP BY ALL")
def industry_time_series(spark, sf_dir):
    return rp.share_of(postings(spark, sf_dir), "industry", "year")


@query(
    "occupation_level",
    f"""{_P}, l AS (SELECT l_orderkey AS id, arg_min(p_type, l_linenumber * 1000000 + l_partkey) AS occupation
      FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
    SELECT year, occupation, {_SHARE} FROM posts LEFT JOIN l USING (id) GROUP BY ALL""",
)
def occupation_level(spark, sf_dir):
    """First occupation per posting: the type of the part in its first line."""
    from vacanta.operators.nest import Child, nest_children
    from vacanta.operators.prepare import first_name

    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    lines = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    tag = F.struct("l_linenumber", "l_partkey", F.col("p_type").alias("name"))
    nested = nest_children(postings(spark, sf_dir).drop("occupation"), "id", [Child(lines, "l_orderkey", tag, "occupations")])
    return rp.share_of(nested.withColumn("occupation", first_name(F.col("occupations"))), "year", "occupation")


@query(
    "adoption_index",
    f"""{_P}, fy AS (SELECT firm_id, year, count(*) FILTER (flag) AS n FROM posts GROUP BY ALL),
    fa AS (SELECT firm_id, min(year) AS y FROM fy WHERE n >= 1 GROUP BY firm_id),
    sp AS (SELECT unnest(range(1993, 2003)) AS year),
    x AS (SELECT sp.year, (SELECT count(*) FROM fa WHERE y = sp.year) AS new_adopters,
      (SELECT count(*) FROM fy WHERE fy.year = sp.year) AS total_firms_posting FROM sp),
    z AS (SELECT *, CAST(sum(new_adopters) OVER (ORDER BY year) AS BIGINT) AS adopting_firms_count FROM x)
    SELECT *, CASE WHEN total_firms_posting > 0 THEN round(100.0 * adopting_firms_count / total_firms_posting, 6) END AS adoption_share
    FROM z""",
)
def adoption_index(spark, sf_dir):
    return rp.adoption_index(postings(spark, sf_dir), 1993, 2002)


@query(
    "firm_intensity_top20",
    f"""{_P}, f AS (SELECT year, firm_id, arg_min(company_name, id) AS company_name, count(*) AS total_postings,
        count(*) FILTER (flag) AS genai_postings, 100.0 * count(*) FILTER (flag) / count(*) AS i
      FROM posts GROUP BY year, firm_id HAVING count(*) >= 2 AND count(*) FILTER (flag) > 0)
    SELECT year, firm_id, company_name, total_postings, genai_postings, round(i, 6) AS genai_intensity,
      row_number() OVER (PARTITION BY year ORDER BY i DESC, firm_id) AS rank FROM f
    QUALIFY rank <= 20""",
)
def firm_intensity_top20(spark, sf_dir):
    return rp.firm_intensity_top(postings(spark, sf_dir), min_postings=2)


_PIVOT = """count(*) FILTER (grp = '1') AS n_1, count(*) FILTER (grp = '2') AS n_2, count(*) FILTER (grp = '3') AS n_3,
  count(*) FILTER (grp = 'NA') AS "n_NA", count(*) AS total, round(100.0 * count(*) FILTER (grp = '1') / count(*), 6) AS pct_1,
  round(100.0 * count(*) FILTER (grp = '2') / count(*), 6) AS pct_2, round(100.0 * count(*) FILTER (grp = '3') / count(*), 6) AS pct_3,
  count(*) FILTER (grp <> 'NA') AS n_any, round(100.0 * count(*) FILTER (grp <> 'NA') / count(*), 6) AS pct_any"""


@query("group_share_yearly", f"{_P} SELECT year, {_PIVOT} FROM posts GROUP BY year")
def group_share_yearly(spark, sf_dir):
    return rp.group_pivot(postings(spark, sf_dir), "year")


@query(
    "group_share_monthly",
    f"""{_P}, p AS (SELECT strftime(created, '%Y-%m') AS month, {_PIVOT} FROM posts GROUP BY 1)
    SELECT month, 'Group 1 share' AS series, pct_1 AS share_pct FROM p
    UNION ALL SELECT month, 'Any group share', pct_any FROM p""",
)
def group_share_monthly(spark, sf_dir):
    dated = postings(spark, sf_dir).withColumn("month", rp.month_of("created"))
    return rp.group_share_long(dated, "month")


@query(
    "share_by_dim",
    f"""{_P}, s AS (
      SELECT 'industry' AS dim, seg AS value, count(*) AS total, count(*) FILTER (grp <> 'NA') AS flagged FROM posts GROUP BY seg HAVING count(*) >= 50
      UNION ALL SELECT 'status', status, count(*), count(*) FILTER (grp <> 'NA') FROM posts GROUP BY status)
    SELECT *, round(100.0 * flagged / total, 6) AS share FROM s
    QUALIFY dim = 'status' OR row_number() OVER (PARTITION BY dim ORDER BY flagged / total DESC, value) <= 3""",
)
def share_by_dim(spark, sf_dir):
    """By industry with support and limit; by contract status without either."""
    p = postings(spark, sf_dir)
    out = rp.share_by(p, "industry", _is_flagged(), 50, 3).withColumnRenamed("industry", "value").withColumn("dim", F.lit("industry"))
    status = rp.share_by(p, "status", _is_flagged()).withColumnRenamed("status", "value").withColumn("dim", F.lit("status"))
    return out.unionByName(status)


@query(
    "share_by_exploded_dim",
    f"""{_P}, e AS (SELECT DISTINCT id, l_suppkey % 26 AS canton, grp FROM posts JOIN lineitem ON l_orderkey = id),
    s AS (SELECT canton, count(*) AS total, count(*) FILTER (grp <> 'NA') AS flagged FROM e GROUP BY canton HAVING count(*) >= 50)
    SELECT *, round(100.0 * flagged / total, 6) AS share FROM s ORDER BY flagged / total DESC, canton LIMIT 15""",
)
def share_by_exploded_dim(spark, sf_dir):
    """Regions of a posting: one per supplier group of its lines."""
    from vacanta.operators.nest import Child, nest_children

    lines = table(spark, sf_dir, "lineitem")
    region = Child(lines, "l_orderkey", F.col("l_suppkey") % 26, "canton", distinct=True)
    nested = nest_children(postings(spark, sf_dir), "id", [region])
    return rp.share_by(nested, "canton", _is_flagged(), 50, 15, explode=True)


@query(
    "distinct_adopters",
    f"""{_P} SELECT year, count(DISTINCT firm_id) AS adopting_firms FROM posts WHERE grp <> 'NA' GROUP BY ROLLUP (year)""",
)
def distinct_adopters(spark, sf_dir):
    return rp.distinct_adopters(postings(spark, sf_dir))


@query(
    "rate_vs_benchmark",
    f"""{_P}, r AS (SELECT count(*) AS total, count(*) FILTER (grp <> 'NA') AS flagged FROM posts WHERE year >= 1999)
    SELECT total, flagged, round(100.0 * flagged / total, 6) AS rate_pct, round(100.0 * flagged / total / 0.175, 6) AS ratio FROM r""",
)
def rate_vs_benchmark(spark, sf_dir):
    return rp.rate_vs_benchmark(postings(spark, sf_dir), _is_flagged(), 1999, 0.175)


_EVENT_FLAG = "CASE event_type WHEN 'purchase' THEN true WHEN 'click' THEN NULL ELSE false END"


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("homeoffice", F.expr(_EVENT_FLAG))


@query(
    "monthly_volume",
    """SELECT 'orders' AS src, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS postings FROM orders GROUP BY ALL
    UNION ALL SELECT 'events', strftime(ts, '%Y-%m'), count(*) FROM events GROUP BY ALL""",
)
def monthly_volume(spark, sf_dir):
    orders = rp.monthly_volume(table(spark, sf_dir, "orders"), "o_orderdate").withColumn("src", F.lit("orders"))
    events = rp.monthly_volume(table(spark, sf_dir, "events"), "ts").withColumn("src", F.lit("events"))
    return orders.unionByName(events)


@query(
    "monthly_boolean_share",
    """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS postings, count(*) FILTER (o_orderstatus = 'F') AS true_postings,
      round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS share FROM orders GROUP BY ALL""",
)
def monthly_boolean_share(spark, sf_dir):
    flag = F.expr("CASE o_orderstatus WHEN 'F' THEN true WHEN 'P' THEN NULL ELSE false END")
    return rp.monthly_boolean_share(table(spark, sf_dir, "orders"), "o_orderdate", flag)


@query(
    "fiscal_composition",
    """WITH w AS (SELECT CASE WHEN month(o_orderdate) >= 11 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS win,
        month(o_orderdate) AS m, CASE o_orderstatus WHEN 'F' THEN 'mentioned' WHEN 'O' THEN 'not mentioned' ELSE 'not coded' END AS category
      FROM orders),
    full_years AS (SELECT win FROM w GROUP BY win HAVING count(DISTINCT m) >= 12)
    SELECT win, category, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY win), 6) AS share
    FROM w WHERE win IN (SELECT win FROM full_years) GROUP BY win, category""",
)
def fiscal_composition(spark, sf_dir):
    flag = F.expr("CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END")
    category = three_valued(flag, "mentioned", "not mentioned", "not coded")
    return rp.fiscal_composition(table(spark, sf_dir, "orders"), "o_orderdate", category)


_BRANDS = """brands AS (SELECT p_brand AS code, count(*) AS n_total,
    count(*) FILTER (l_returnflag = 'R') AS n_true, count(*) FILTER (l_returnflag = 'A') AS n_false
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand),
b2 AS (SELECT *, n_true + n_false AS n_coded, n_true / (n_true + n_false) AS share FROM brands WHERE n_true + n_false >= 50)"""


def _brand_shares(spark, sf_dir, denominator="coded") -> DataFrame:
    """Returned lines per brand; lines neither returned nor accepted are not coded."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("code"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    flag = F.expr("CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END")
    return rp.share_by_code(
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), "code", flag, 50, denominator
    )


@query(
    "share_by_code",
    f"WITH {_BRANDS} SELECT code, n_total, n_true, n_false, n_coded, round(n_true / n_total, 6) AS share FROM b2",
)
def share_by_code(spark, sf_dir):
    return _brand_shares(spark, sf_dir, "all")


def _brand_exposure(spark, sf_dir) -> DataFrame:
    price = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("code")).agg(F.avg("p_retailprice").alias("exposure"))
    return _brand_shares(spark, sf_dir).join(price, "code")


@query(
    "share_exposure_ols",
    f"""WITH {_BRANDS}, e AS (SELECT p_brand AS code, avg(p_retailprice) AS x FROM part GROUP BY p_brand),
    f AS (SELECT regr_slope(share, x) AS slope, regr_intercept(share, x) AS intercept, regr_r2(share, x) AS r2,
        regr_sxx(share, x) AS sxx, regr_syy(share, x) AS syy, regr_sxy(share, x) AS sxy, count(*) AS n FROM b2 JOIN e USING (code)),
    g AS (SELECT *, sqrt((syy - slope * sxy) / (n - 2) / sxx) AS se FROM f),
    t AS (SELECT *, abs(slope / se) AS t, CAST(n - 2 AS DOUBLE) AS v FROM g),
    -- Simpson's rule over the density of Student's t between 0 and |t|
    pdf AS (SELECT i, t.t / 20000 AS h, exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi())
        * pow(1 + pow(i * t.t / 20000, 2) / v, -(v + 1) / 2) AS d
      FROM t CROSS JOIN (SELECT unnest(range(0, 20001)) AS i)),
    p AS (SELECT 1 - 2 * sum(h / 3 * d * CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) AS p FROM pdf)
    SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(se, 6) AS se, round(p, 6) AS p_value,
      round(r2, 6) AS r2, n FROM t CROSS JOIN p""",
)
def share_exposure(spark, sf_dir):
    return share_exposure_ols(_brand_exposure(spark, sf_dir), "share", "exposure")


@query(
    "top_bottom",
    f"""WITH {_BRANDS} SELECT * FROM (SELECT 'Top 10' AS panel, code, round(share, 6) AS share, n_coded FROM b2 ORDER BY b2.share DESC, code LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'Bottom 10', code, round(share, 6), n_coded FROM b2 ORDER BY b2.share, code LIMIT 10)""",
)
def top_bottom_query(spark, sf_dir):
    return top_bottom(_brand_shares(spark, sf_dir), "share", "code").select("panel", "code", "share", "n_coded")


@query(
    "wfh_diagnostics",
    f"""WITH e AS (SELECT user_id, {_EVENT_FLAG} AS f FROM events),
    c AS (SELECT user_id, count(*) AS n, count(*) FILTER (f) AS t, count(*) FILTER (NOT f) AS x FROM e GROUP BY user_id),
    w AS (SELECT sum(n) AS n_rows, sum(n - t - x) AS n_missing, sum(t) AS n_true, sum(x) AS n_false, count(*) AS n_cells,
        count(*) FILTER (t + x < 50) AS n_cells_below, coalesce(sum(t + x) FILTER (t + x < 50), 0) AS coded_in_dropped_cells,
        sum(t + x) AS total_coded FROM c)
    SELECT metric, CAST(value AS DOUBLE) AS value FROM (UNPIVOT (SELECT n_rows::DOUBLE AS n_rows, n_missing::DOUBLE AS n_missing,
      n_true::DOUBLE AS n_true, n_false::DOUBLE AS n_false, n_cells::DOUBLE AS n_cells, n_cells_below::DOUBLE AS n_cells_below,
      coded_in_dropped_cells::DOUBLE AS coded_in_dropped_cells, total_coded::DOUBLE AS total_coded,
      round_even(100.0 * n_missing / n_rows, 2) AS pct_missing, round_even(100.0 * n_true / n_rows, 2) AS pct_true,
      round_even(100.0 * n_false / n_rows, 2) AS pct_false, round_even(100.0 * n_cells_below / n_cells, 1) AS pct_cells_below FROM w)
      ON COLUMNS(*) INTO NAME metric VALUE value)""",
)
def wfh_diagnostics(spark, sf_dir):
    return flag_diagnostics(_events(spark, sf_dir), "homeoffice", "user_id", 50)


# ---- duplicates and outliers ---------------------------------------------------------------------

_L = f"WITH {sql.LINES}"


@query(
    "dedup_within_year",
    f"""{_L} SELECT year, l_orderkey, l_linenumber, k AS duplicate_group FROM lines
    QUALIFY k IS NULL OR row_number() OVER (PARTITION BY year, k ORDER BY created, l_orderkey, l_linenumber) = 1""",
)
def dedup_within_year_query(spark, sf_dir):
    out = dedup_within_year(lines_dated(spark, sf_dir), "duplicate_group", ["created", "l_orderkey", "l_linenumber"])
    return out.select("year", "l_orderkey", "l_linenumber", "duplicate_group")


@query(
    "dedup_keep_earliest",
    f"""{_L} SELECT l_orderkey, l_linenumber, k AS duplicate_group FROM lines
    QUALIFY k IS NULL OR row_number() OVER (PARTITION BY k ORDER BY created, l_orderkey, l_linenumber) = 1""",
)
def dedup_keep_earliest(spark, sf_dir):
    out = keep_first(lines_dated(spark, sf_dir), "duplicate_group", ["created", "l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "duplicate_group")


@query(
    "duplicate_diagnostics",
    f"""{_L}, g AS (SELECT k, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS f FROM lines GROUP BY k)
    SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (n > 1) AS n_dup_groups,
      CAST(sum(n - 1) FILTER (n > 1) AS BIGINT) AS n_surplus_rows, count(*) FILTER (f > 1) AS n_flagged_dup_groups,
      CAST(sum(f) FILTER (f > 1) AS BIGINT) AS n_flagged_dup_rows,
      round(100.0 * sum(n - 1) FILTER (n > 1) / sum(n), 6) AS surplus_pct FROM g""",
)
def duplicate_diagnostics_query(spark, sf_dir):
    lines = lines_dated(spark, sf_dir).withColumn("flagged", F.col("l_returnflag") == "R")
    return duplicate_diagnostics(lines, "duplicate_group", "flagged")


_Z = {"BUILDING": 0.05, "MACHINERY": 0.10, "HOUSEHOLD": 0.025}
_OUT = f"""{_P}, c AS (SELECT firm_id, seg, year, count(*) AS n, ln(count(*) + 1) AS l FROM posts WHERE seg IS NOT NULL GROUP BY ALL),
s AS (SELECT year, seg, avg(l) AS m, stddev_samp(l) AS sd FROM c GROUP BY ALL),
outl AS (SELECT firm_id, seg, year, n, exp(m + CASE seg WHEN 'BUILDING' THEN 1.96 WHEN 'MACHINERY' THEN 1.645
    WHEN 'HOUSEHOLD' THEN 2.24 ELSE 2.576 END * sd) - 1 AS upper FROM c JOIN s USING (year, seg)),
flagged AS (SELECT * FROM outl WHERE n - upper > 1e-9)"""


def _outliers(p: DataFrame) -> DataFrame:
    return outlier_firm_years(p, _Z, 0.01)


@query(
    "outlier_firm_years",
    f"{_OUT} SELECT firm_id, seg AS size_id, year, n AS n_postings, round(upper, 6) AS upper FROM flagged",
)
def outlier_firm_years_query(spark, sf_dir):
    return _outliers(postings(spark, sf_dir))


@query(
    "outlier_firm_antijoin",
    f"""{_OUT} SELECT year, count(*) AS kept, count(DISTINCT firm_id) AS firms FROM posts p
    WHERE NOT EXISTS (SELECT 1 FROM flagged f WHERE f.firm_id = p.firm_id AND f.year = p.year) GROUP BY year""",
)
def outlier_firm_antijoin(spark, sf_dir):
    p = postings(spark, sf_dir)
    kept = drop_outlier_firm_years(p, _outliers(p))
    return kept.groupBy("year").agg(F.count(F.lit(1)).alias("kept"), F.countDistinct("firm_id").alias("firms"))


# ---- crosswalks -----------------------------------------------------------------------------------


def _two_hop(spark, sf_dir) -> DataFrame:
    """Customer to nation to region; every customer has an older entry in another nation too."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("mid")
    )
    old = c.withColumn("mid", (F.col("mid") + 1) % 25).withColumn("catalogue", F.lit("2000"))
    first = c.withColumn("catalogue", F.lit("2020")).unionByName(old)
    second = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("mid"), F.col("n_regionkey").alias("code"))
    titles = table(spark, sf_dir, "region").where("r_name <> 'ASIA'").select(
        F.col("r_regionkey").alias("code"), F.col("r_name").alias("title")
    )
    return two_hop(first, second, titles)


@query(
    "crosswalk_two_hop",
    """SELECT c_custkey AS id, CAST(n_regionkey AS BIGINT) AS code, CAST(n_regionkey // 10 AS BIGINT) AS parent,
      CASE WHEN r_name <> 'ASIA' THEN r_name ELSE c_name END AS label
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
)
def crosswalk_two_hop(spark, sf_dir):
    return _two_hop(spark, sf_dir).withColumn("parent", rolled_up(F.col("code")))


_TAGS = """SELECT l_orderkey AS id, p_brand AS tag FROM lineitem JOIN part ON p_partkey = l_partkey"""
_MM = f"""WITH tags AS ({_TAGS}),
x AS (SELECT DISTINCT p_brand AS tag, p_size AS mid FROM part WHERE p_size <= 20),
y AS (SELECT DISTINCT p_size AS mid, p_size * 7 % 50 AS code FROM part WHERE p_size % 2 = 0),
xk AS (SELECT * FROM x WHERE mid IN (SELECT mid FROM y) AND tag <> 'Brand#3'),
codes AS (SELECT DISTINCT t.id, CAST(y.code AS BIGINT) AS code FROM tags t JOIN xk USING (tag) JOIN y USING (mid))"""


def _mm(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    brands = part.select("p_partkey", F.col("p_brand").alias("tag"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey")
    tags = lines.join(brands, F.col("l_partkey") == F.col("p_partkey")).select("id", "tag")
    first = part.where("p_size <= 20 AND p_brand <> 'Brand#3'").select(F.col("p_brand").alias("tag"), F.col("p_size").alias("mid"))
    second = part.where("p_size % 2 = 0").select(F.col("p_size").alias("mid"), (F.col("p_size") * 7 % 50).alias("code"))
    return tags, first.distinct(), second.distinct()


@query("crosswalk_many_many", f"{_MM} SELECT id, code, code // 10 AS parent FROM codes")
def crosswalk_many_many(spark, sf_dir):
    out = many_to_many(*_mm(spark, sf_dir), "id", "tag")
    return out.withColumn("parent", rolled_up(F.col("code")))


@query(
    "crosswalk_match_rate",
    f"""{_MM}, j AS (SELECT xk.mid FROM tags t LEFT JOIN xk USING (tag))
    SELECT count(*) AS n_rows, round_even(100.0 * avg(CAST(mid IS NULL AS INT)), 2) AS pct_unmatched FROM j""",
)
def crosswalk_match_rate(spark, sf_dir):
    return unmatched_rate(*_mm(spark, sf_dir), "tag")


@query(
    "monthly_two_series",
    f"""{_MM}, o AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-01') AS month FROM orders),
    a AS (SELECT month, count(*) AS n_ads FROM o GROUP BY month),
    c AS (SELECT month, count(DISTINCT code) AS n_codes FROM codes JOIN o USING (id) GROUP BY month)
    SELECT month, n_ads, coalesce(n_codes, 0) AS n_codes FROM a FULL JOIN c USING (month)""",
)
def monthly_two_series(spark, sf_dir):
    codes = many_to_many(*_mm(spark, sf_dir), "id", "tag")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    out = rp.monthly_two_series(orders, codes, "id", "o_orderdate", "code")
    return out.withColumn("month", F.date_format("month", "yyyy-MM-dd"))


# ---- tags, semi and anti joins --------------------------------------------------------------------


@query(
    "anti_join_excluded",
    """SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS
      (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""",
)
def anti_join_excluded(spark, sf_dir):
    excluded = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct()
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(excluded, "id", "left_anti")


@query(
    "semi_join_kept",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01')""",
)
def semi_join_kept(spark, sf_dir):
    kept = half_open(table(spark, sf_dir, "orders"), "o_orderdate", "1998-01-01", "1999-01-01")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return lines.join(kept.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")


@query(
    "ads_per_tag",
    """SELECT l_suppkey AS jobid, count(DISTINCT o_orderkey) AS n_ads, count(*) AS n_rows FROM orders
    JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' GROUP BY l_suppkey""",
)
def ads_per_tag(spark, sf_dir):
    tags = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("jobid"))
    joined = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(tags, "id")
    per_ad = joined.groupBy("jobid", "id").agg(F.count(F.lit(1)).alias("n"))
    return per_ad.groupBy("jobid").agg(F.count(F.lit(1)).alias("n_ads"), F.sum("n").alias("n_rows"))


def _tagged(spark, sf_dir) -> DataFrame:
    """Orders with an array of tags: the return flag line by line as id, some not a number."""
    from vacanta.operators.nest import Child, nest_children

    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.expr("CASE WHEN l_quantity > 45 THEN 'x' ELSE CAST(CAST(l_quantity AS INT) % 3 AS STRING) END").alias("id")
    )
    child = Child(lines, "l_orderkey", F.struct("l_linenumber", "id"), "tags")
    return nest_children(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", [child])


_TAG = """tg AS (SELECT l_orderkey AS o_orderkey, l_linenumber AS ln,
    CASE WHEN l_quantity > 45 THEN 'x' ELSE CAST(CAST(trunc(l_quantity) AS INT) % 3 AS VARCHAR) END AS id FROM lineitem),
tn AS (SELECT o_orderkey, count(*) AS n, count(*) FILTER (id IN ('0', '2')) AS others,
    coalesce(min(struct_pack(a := ln, b := id)) FILTER (id = 'x') < min(struct_pack(a := ln, b := id)) FILTER (id IN ('0', '2')), false) AS bad_first
  FROM tg GROUP BY o_orderkey),
kept AS (SELECT tg.*, (n > 1 AND others > 0 AND NOT bad_first) AS strict, (n > 1 AND others > 0) AS lax FROM tg JOIN tn USING (o_orderkey))"""


@query(
    "drop_secondary_tag",
    f"""WITH {_TAG} SELECT o.o_orderkey,
      coalesce((SELECT string_agg(id, ',' ORDER BY ln, id) FROM kept k WHERE k.o_orderkey = o.o_orderkey AND NOT (strict AND id = '1')), '') AS strict_tags,
      coalesce((SELECT string_agg(id, ',' ORDER BY ln, id) FROM kept k WHERE k.o_orderkey = o.o_orderkey AND NOT (lax AND id = '1')), '') AS lax_tags
    FROM orders o""",
)
def drop_secondary_tag_query(spark, sf_dir):
    def ids(strict):
        return F.array_join(drop_secondary_tag(F.col("tags"), 1, strict)["id"], ",")

    return _tagged(spark, sf_dir).select("o_orderkey", ids(True).alias("strict_tags"), ids(False).alias("lax_tags"))


@query(
    "ambiguous_tag_cap",
    """WITH n AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
    SELECT 'array' AS form, n AS n_tags, count(*) AS n_ads FROM n WHERE n <= 5 GROUP BY n
    UNION ALL SELECT 'rows', n, count(*) FROM n WHERE n BETWEEN 1 AND 5 GROUP BY n""",
)
def ambiguous_tag_cap(spark, sf_dir):
    """As an array column and as one row per tag."""
    arrays = drop_ambiguous(_tagged(spark, sf_dir), "tags").groupBy(F.size("tags").alias("n_tags"))
    out = arrays.agg(F.count(F.lit(1)).alias("n_ads")).withColumn("form", F.lit("array"))
    rows = drop_ambiguous_ids(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey")
    per_id = rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_tags"))
    long = per_id.groupBy("n_tags").agg(F.count(F.lit(1)).alias("n_ads")).withColumn("form", F.lit("rows"))
    return out.unionByName(long)


@query(
    "occupation_share",
    f"""WITH {_TAG}, clean AS (SELECT o_orderkey, ln, id FROM kept WHERE NOT (strict AND id = '1')),
    ok AS (SELECT o_orderkey FROM clean GROUP BY o_orderkey HAVING count(*) <= 5),
    codes AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_regionkey AS code, CASE WHEN r_name <> 'ASIA' THEN r_name ELSE n_name END AS label
      FROM nation JOIN region ON r_regionkey = n_regionkey),
    s AS (SELECT code, label, count(*) AS total_ads, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS flagged_ads
      FROM clean JOIN ok USING (o_orderkey) JOIN orders USING (o_orderkey) JOIN codes USING (id) GROUP BY ALL HAVING count(*) >= 20)
    SELECT CAST(code AS BIGINT) AS code, label, total_ads, flagged_ads, round(flagged_ads / total_ads, 6) AS share,
      flagged_ads / total_ads > 0.5 AND total_ads < 100 AS small_sample FROM s""",
)
def occupation_share_query(spark, sf_dir):
    """Drop the secondary tag, drop ambiguous postings, map tags over two hops, share per code."""
    tagged = _tagged(spark, sf_dir).withColumn("tags", drop_secondary_tag(F.col("tags"), 1))
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"),
        F.col("n_nationkey").alias("mid"), F.lit("2020").alias("catalogue"),
    )
    second = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("mid"), F.col("n_regionkey").alias("code"))
    titles = table(spark, sf_dir, "region").where("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("title"))
    flag = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")
    return occupation_share(drop_ambiguous(tagged, "tags"), two_hop(nation, second, titles), flag, "tags")
