"""Registered queries: jobs, read back from what they wrote, and file loaders."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacanta.operators import triple_lock as tl
from vacanta.operators.dictionary import read_translations, read_validated
from vacanta.plans import sql
from vacanta.plans.catalog_stats import RULES
from vacanta.plans.catalog_text import matched
from vacanta.plans.jobs import AGGREGATIONS, Pool, run_aggregations, run_calibration, run_export, run_incremental, run_rules
from vacanta.plans.registry import ORACLES, query
from vacanta.plans.views import TEST_DICTIONARY, ads, order_group, postings, table
from vacanta.sources.io import read_code_map, read_isco_titles, read_occupation_map
from vacanta.sources.staging import new_path

#: Keywords of a written dictionary document, about.
DOCUMENT = 10_000


@query("job_calibration", ORACLES["v7_grid_sweep"])
def job_calibration(spark, sf_dir):
    """Both keyword pools in one run; the sweeps are read back from the written tables."""
    target = new_path(spark, "calibration")
    dropped = tuple(k.keyword for k in TEST_DICTIONARY.keywords if k.source == "LLM")
    run_calibration(matched(spark, sf_dir), TEST_DICTIONARY, target, {"full": Pool(), "no_layer3": Pool(dropped)})
    sweep = lambda name: spark.read.parquet(f"{target}/{name}/sweep").withColumn("run", F.lit(name))
    return sweep("full").unionByName(sweep("no_layer3"))


@query("job_rules", ORACLES["flag_rules"])
def job_rules(spark, sf_dir):
    """The earlier scoring as a job; the second run uses the kept counts."""
    target, counts = new_path(spark, "rules"), new_path(spark, "counts")
    for _ in range(2):
        run_rules(ads(spark, sf_dir), TEST_DICTIONARY, counts, target, RULES, tl.copilot_context("thble", "attion"))
    return spark.read.parquet(f"{target}/scored").select(
        "ad_id", F.array_join("matched_keywords", "|").alias("matched_keywords"), "g1_count", "g2_count",
        F.size("matched_g3_keywords").alias("g3_count"),
        "flag_rule_1", "flag_rule_2", "flag_rule_3", "flag_rule_copilot", "genai_flag",
    )


@query(
    "job_aggregations",
    f"""WITH {sql.POSTS}, fy AS (SELECT firm_id, year, count(*) AS n, count(*) FILTER (flag) AS f FROM posts GROUP BY ALL)
    SELECT 'time_series' AS report, count(DISTINCT year) AS n_rows, CAST(count(*) AS BIGINT) AS total FROM posts
    UNION ALL SELECT 'industry_level', count(DISTINCT seg), count(*) FROM posts
    UNION ALL SELECT 'firm_level', (SELECT count(*) FROM (SELECT DISTINCT firm_id FROM posts)), count(*) FROM posts
    UNION ALL SELECT 'firm_intensity', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM (
      SELECT * FROM fy WHERE n >= 5 AND f > 0 QUALIFY row_number() OVER (PARTITION BY year ORDER BY 100.0 * f / n DESC, firm_id) <= 20)""",
)
def job_aggregations(spark, sf_dir):
    """Report tables in all three file kinds, read back."""
    target, scored = new_path(spark, "reports"), postings(spark, sf_dir)
    kinds = {"time_series": "csv", "industry_level": "json", "firm_level": "parquet", "firm_intensity": "csv"}
    out = None
    for name, kind in kinds.items():
        (path,) = run_aggregations(scored, f"{target}/{kind}", kind, (name,))
        back = spark.read.option("header", True).format(kind).load(path)
        counted = back.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.col("total_postings").cast("long")), F.lit(0)).alias("total"))
        counted = counted.select(F.lit(name).alias("report"), "n_rows", "total")
        out = counted if out is None else out.unionByName(counted)
    return out


@query(
    "job_aggregations_all",
    f"""WITH {sql.POSTS}, g AS (SELECT DISTINCT seg, year FROM posts)
    SELECT count(*) AS cells, (SELECT count(*) FROM posts) AS postings FROM g""",
)
def job_aggregations_all(spark, sf_dir):
    """The whole set of reports in one call; one of them is read back."""
    target = new_path(spark, "reports")
    paths = run_aggregations(postings(spark, sf_dir), target)
    if len(paths) != len(AGGREGATIONS):
        raise RuntimeError("a report is missing")
    back = spark.read.parquet(f"{target}/industry_time_series")
    return back.agg(F.count(F.lit(1)).alias("cells"), F.sum("total_postings").alias("postings"))


@query(
    "job_export",
    """WITH e AS (SELECT event_id, user_id, value, CASE WHEN event_id % 40 <> 7 THEN ts END AS ts FROM events)
    SELECT count(*) AS expected, count(*) AS exported, true AS complete, count(DISTINCT CAST(ts AS DATE)) AS days,
      count(*) - count(ts) AS undated, round(sum(value), 2) AS total, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_children
    FROM e LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = user_id""",
)
def job_export(spark, sf_dir):
    """Export by day in two runs: the first sees a part of the rows and other values in some of them, the second
    redoes the days that have changed. Some postings have no date."""
    target, orders = new_path(spark, "export"), table(spark, sf_dir, "orders")
    events = table(spark, sf_dir, "events").withColumn("ts", F.when(F.col("event_id") % 40 != 7, F.col("ts")))

    def widen(df):
        children = orders.groupBy(F.col("o_custkey").alias("user_id")).agg(F.collect_list("o_orderkey").alias("children"))
        return df.join(children, "user_id", "left")

    corrected = F.when(F.coalesce(F.dayofmonth("ts"), F.lit(5)) == 5, F.col("value") + 1).otherwise(F.col("value"))
    run_export(events.where("coalesce(day(ts) <> 3, true) AND coalesce(day(ts), 0) <> 9").withColumn("value", corrected), widen, target, "ts")
    out = run_export(events, widen, target, "ts")
    back = spark.read.parquet(target).agg(
        F.countDistinct("day").alias("days"), F.count_if(F.col("day").isNull()).alias("undated"), F.round(F.sum("value"), 2).alias("total"),
        F.sum(F.greatest(F.size("children"), F.lit(0))).alias("n_children"),
    )
    return out.withColumns({name: back.select(name).scalar() for name in back.columns})


@query(
    "job_incremental",
    """SELECT CASE WHEN o_orderkey % 50 <> 0 THEN year(o_orderdate) END AS year, count(*) AS n,
      count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS flagged,
      coalesce(any_value(CASE WHEN o_orderkey % 50 <> 0 THEN year(o_orderdate) END) IN (1996, 1999, 2000, 2001), false) AS redone
    FROM orders GROUP BY 1""",
)
def job_incremental(spark, sf_dir):
    """Classification by year: the second run takes the years that were not there yet and the one whose rows have
    changed; undated rows are a partition too."""
    target = new_path(spark, "classified")
    orders = table(spark, sf_dir, "orders").withColumn("year", F.when(F.col("o_orderkey") % 50 != 0, F.year("o_orderdate")))
    job = lambda df: df.withColumn("group", order_group())
    other = F.when(F.col("year") == 1996, F.lit("5-LOW")).otherwise(F.col("o_orderpriority"))
    run_incremental(orders.where("coalesce(year, 0) < 1999").withColumn("o_orderpriority", other), job, target)
    stale = run_incremental(orders, job, target)
    out = spark.read.parquet(target).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("group") != "NA").alias("flagged"))
    redone = stale.select(F.col("year").alias("_year"), F.lit(True).alias("redone"))
    return out.join(redone, F.col("year").eqNullSafe(F.col("_year")), "left").drop("_year").fillna(False, ["redone"])


@query(
    "crosswalk_files",
    """SELECT CAST(p_size % 7 AS BIGINT) AS code, 'Führung ' || (p_size % 7) AS title, count(*) AS n, count(DISTINCT p_brand) AS catalogues
    FROM part WHERE p_size % 7 <> 3 GROUP BY ALL""",
)
def crosswalk_files(spark, sf_dir):
    """The three crosswalk files, written as they come and read with their loaders."""
    base, part = new_path(spark, "crosswalk"), table(spark, sf_dir, "part")
    names = ["id (x28)", "name (x28)", "code (AVAM)", "name (AVAM)", "name (Catalogue)"]
    part.select("p_partkey", "p_name", "p_size", "p_type", "p_brand").toDF(*names).write.option("header", True).csv(f"{base}/occupations")
    codes = part.select(F.col("p_size").alias("avam"), (F.col("p_size") % 7).alias("isco")).distinct()
    codes.write.option("header", True).csv(f"{base}/codes")
    titles = codes.select("isco").distinct().where("isco <> 3")
    titles = titles.select(F.lit("ISCO-08").alias("ISCO_version"), F.col("isco").alias("unit"), F.concat(F.lit(" Führung "), "isco").alias("description"))
    old = titles.withColumn("ISCO_version", F.lit("ISCO-88"))
    titles.unionByName(old).write.option("header", True).option("encoding", "iso-8859-1").csv(f"{base}/titles")
    occupations = read_occupation_map(spark, f"{base}/occupations")
    coded = occupations.join(read_code_map(spark, f"{base}/codes"), "mid").join(read_isco_titles(spark, f"{base}/titles"), "code")
    return coded.groupBy("code", "title").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("catalogue").alias("catalogues"))


@query(
    "dictionary_files",
    """SELECT 'validated' AS file, CAST(p_size % 3 + 1 AS VARCHAR) AS part, count(*) AS n, min(p_name || p_partkey) AS first FROM part GROUP BY ALL
    UNION ALL SELECT 'translations', 'de' || (p_size % 3 + 1), count(*), min(p_brand || '-' || p_partkey) FROM part GROUP BY ALL""",
)
def dictionary_files(spark, sf_dir):
    """Validated keywords and translations as JSON documents, read with their loaders."""
    base, part = new_path(spark, "dictionary"), table(spark, sf_dir, "part")
    record = F.struct(
        F.concat("p_name", "p_partkey").alias("keyword"), (F.col("p_size") % 3 + 1).alias("group"), F.lit("St").alias("source"),
        F.lit(0.5).alias("dhs_rate"), F.lit(1.5).alias("avg_ratio"),
    )
    # Documents of bounded size, one per file: their number follows the table.
    parts = -(-part.count() // DOCUMENT) or 1
    documents = part.groupBy(F.pmod(F.xxhash64("p_brand", "p_partkey"), F.lit(parts)))
    write = lambda value, name: documents.agg(F.to_json(value).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(f"{base}/{name}")
    write(F.struct(F.collect_list(record).alias("keywords")), "validated")
    form = F.concat_ws("-", "p_brand", "p_partkey")
    layers = [
        F.struct(F.collect_list(F.when(F.col("p_size") % 3 + 1 == k, form)).alias("keywords"), F.array().cast("array<string>").alias("proper_nouns")).alias(f"layer{k}")
        for k in (1, 2, 3)
    ]
    write(F.struct(F.struct(F.struct(*layers).alias("de")).alias("translations")), "translations")
    validated = read_validated(spark, f"{base}/validated").groupBy(F.lit("validated").alias("file"), F.col("group").cast("string").alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.min("keyword").alias("first")
    )
    translated = read_translations(spark, f"{base}/translations").groupBy(
        F.lit("translations").alias("file"), F.concat("lang", F.col("layer").cast("string")).alias("part")
    )
    return validated.unionByName(translated.agg(F.count(F.lit(1)).alias("n"), F.min("form").alias("first")))
