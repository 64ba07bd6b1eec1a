"""Preparation on narrow rows against the plain rule on whole rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from vacanta.operators.dedup import dedup_within_year
from vacanta.operators.nest import wide_postings
from vacanta.plans.pipeline import _places, _without, prepare, with_place
from vacanta.schema import PrepareConfig, ad_schema
from vacanta.sources.buckets import bucket_count, open_buckets, store_buckets
from vacanta.sources.staging import new_path, stage


def postings(spark, n=400, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        year = rng.choice([2023, 2024])
        key = None if rng.random() < 0.2 else f"k{rng.randrange(20) if rng.random() < 0.5 else 0}"
        stamp = datetime.datetime(year, rng.randrange(1, 13), 1).strftime("%Y-%m-%d %H:%M:%S")
        company = (rng.randrange(6) if rng.random() < 0.9 else None, "c", None, None, None, None, (57000002, "s", None), None, False)
        rows.append((key, f"t{i}", f"u{i}" if rng.random() < 0.9 else None, stamp, None, None, None, None, None, None, [("CH", None, None, None)], None, f"text {i} " * 50, None, company, None, rng.choice(["de", "en", "xx", None])))
    return spark.createDataFrame(rows, ad_schema())


@pytest.mark.parametrize("staged", [True, False])
def test_first_copies_and_outliers_as_by_whole_rows(spark, staged):
    ads = stage(postings(spark).repartition(4), "ads")
    frame = ads if staged else ads.select("*").distinct()
    got = {r.title: r for r in prepare(frame, PrepareConfig(fallback_alpha=0.1, size_alpha=(("57000002", 0.1),))).collect()}
    flat = ads.withColumns({"date": F.to_timestamp("tst_created"), "year": F.year(F.to_timestamp("tst_created"))})
    unique = [r.asDict(True) for r in dedup_within_year(flat, "duplicate_group", ["date", "url", "title"]).collect()]
    by_key = {(r["year"], r["duplicate_group"]) for r in unique if r["duplicate_group"]}
    assert all(r["language"] in ("de", "en") for r in (x.asDict(True) for x in got.values()))
    kept = [r for r in got.values() if r.duplicate_group is not None]
    assert len(kept) == len({(r.year, r.duplicate_group) for r in kept}) and {(r.year, r.duplicate_group) for r in kept} <= by_key
    # Where date and URL settle it, the same row stays; rows without a key all stay.
    first = {(r["year"], r["duplicate_group"]): r for r in unique if r["duplicate_group"]}
    for r in kept:
        best = first[r.year, r.duplicate_group]
        assert (r.tst_created, r.url) == (best["date"], best["url"])
    dropped_firms = {(r["_firm_id"] if "_firm_id" in r else r["company"]["id"], r["year"]) for r in unique} - {(r._firm_id, r.year) for r in got.values()}
    lone = [r for r in unique if r["duplicate_group"] is None and r["language"] in ("de", "en") and (r["company"]["id"], r["year"]) not in dropped_firms]
    assert {r["title"] for r in lone} == {r.title for r in got.values() if r.duplicate_group is None}


def test_wide_rows_are_not_shuffled(spark):
    ads = stage(postings(spark, 100), "ads")
    plan = prepare(ads)._jdf.queryExecution().executedPlan().toString()
    # The only shuffle is that of the short list of firm-years.
    assert all("_firm_id#" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2


def relational(spark, n=60):
    ids = spark.range(n).withColumnRenamed("id", "k")
    none = F.lit(None)
    adv = ids.select(
        F.col("k").alias("id"), F.lit("d").alias("duplicategroup"), F.lit("u").alias("url"), F.current_timestamp().alias("created"), none.cast("timestamp").alias("deleted"),
        F.lit("en").alias("language"), F.lit(False).alias("temporary"), F.lit(False).alias("homeoffice"), none.cast("int").alias("workquota_minimum"), none.cast("int").alias("workquota_maximum"),
        F.lit("web").alias("origin"), F.lit(1).alias("company_id"), F.lit("c").alias("company_name"), *[none.cast("string").alias(c) for c in ("company_uid", "company_crn", "company_url")],
        F.lit(1).alias("company_size_id"), F.lit("s").alias("company_size_name"), none.cast("int").alias("company_size_min"), none.cast("int").alias("company_size_max"), F.lit(False).alias("company_recruitment_agency"),
    )
    key = F.when(F.col("k") % 7 != 0, F.col("k")).alias("advertisement_id")
    child = ids.select(key, F.col("k").cast("int").alias("metadata_id"), F.lit("n").alias("name"), F.lit("JOB").alias("type"), F.lit("TITLE").alias("source"))
    details = ids.select(F.col("k").alias("advertisement_id"), F.lit("t").alias("title"), F.lit("text").alias("raw_text"))
    return [adv, details, child, ids.select(key, F.lit("CH").alias("country")), ids.select(key, F.lit("ZH").alias("canton")), child.withColumn("type", F.lit("INDUSTRY"))]


def test_bucketed_sources_nest_without_a_shuffle(spark):
    sources = relational(spark)
    keys = ["id", *["advertisement_id"] * 5]
    stored = [store_buckets(df, f"nest_source_{i}", key, 8) for i, (df, key) in enumerate(zip(sources, keys, strict=True))]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out, plain = wide_postings(*stored), wide_postings(*sources)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 5 and "Exchange" not in plan
        assert "Exchange hashpartitioning" in plain._jdf.queryExecution().executedPlan().toString()
        drop = lambda df: sorted(map(str, df.drop("created", "tst_created").collect()))
        assert drop(out) == drop(plain)
        # A delivery is appended, another session opens the same files.
        more = store_buckets(sources[1].withColumn("advertisement_id", F.col("advertisement_id") + 1000), "nest_source_1", "advertisement_id", 8, stored[1].inputFiles()[0].rsplit("/", 1)[0], "append")
        assert more.count() == 120
        other = open_buckets(spark.newSession(), "nest_again", more.inputFiles()[0].rsplit("/", 1)[0], more.schema, "advertisement_id", 8)
        assert other.count() == 120 and "Exchange" not in other.groupBy("advertisement_id").count()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    with pytest.raises(ValueError, match="table name"):
        store_buckets(sources[0], "no name", "id", 8)
    assert [bucket_count(n, 10) for n in (0, 10, 11, 25, 41)] == [1, 1, 2, 4, 8]


def test_texts_that_lie_once_are_joined_last(spark):
    """The same wide rows as from details with texts, and texts meet them by their own key only."""
    adv, details, *children = relational(spark)
    texts = spark.createDataFrame([(i, f"t{i}", None if i == 4 else f"text {i}") for i in (0, 1, 2, 3, 3, 4)], "text_id long, title string, raw_text string")
    which = details.select("advertisement_id", F.when(F.col("advertisement_id") != 12, F.col("advertisement_id") % 6).alias("text_id"))
    whole = which.join(texts, "text_id").drop("text_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = wide_postings(adv, which, *children, texts)
        plan = out._jdf.queryExecution().executedPlan().toString()
        drop = lambda df: sorted(map(str, df.drop("created", "tst_created").collect()))
        assert out.count() == 59 and drop(out) == drop(wide_postings(adv, whole, *children))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(text_id#") == 2


def shuffled(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_storing_in_buckets_shuffles_nothing(spark):
    """Rows of many tasks, without a key as well, lie in their buckets, and a task's rows in order of the key."""
    df = spark.range(5_000, numPartitions=5).select(F.when(F.col("id") % 9 != 0, F.col("id") % 700).alias("k"), "id")
    rows, before = sorted(map(str, df.collect())), shuffled(spark)
    stored = store_buckets(df, "stored_as_they_come", "k", 4)
    assert sorted(map(str, stored.collect())) == rows and shuffled(spark) == before
    files = stored.select(F.input_file_name().alias("file"), F.when(F.col("k").isNotNull(), F.pmod(F.hash("k"), F.lit(4))).alias("bucket")).distinct().collect()
    assert len({r.file for r in files}) == 20
    assert all(int(r.file.rsplit("_", 1)[1].split(".")[0]) == r.bucket for r in files if r.bucket is not None)


def test_measures_meet_the_texts_in_place_of_the_arrays(spark):
    adv, details, *children = relational(spark, 3_000)
    texts = spark.createDataFrame([(i, f"t{i}", f"text {i}") for i in (0, 1, 2, 2)], "text_id long, title string, raw_text string")
    which = details.select("advertisement_id", (F.col("advertisement_id") % 4).alias("text_id"))
    many = [c.crossJoin(spark.range(20).drop("id").hint("broadcast")) for c in children]
    measures = {"n": F.size("occupations"), "places": F.size("locations"), "firm": F.size("industries"), "where": F.array_join("cantons_bonus", ",")}
    old = [F.size("occupations").alias("n"), F.size("locations").alias("places"), F.size("company.metadata").alias("firm"), F.array_join("cantons_bonus", ",").alias("where")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = ["id", *["advertisement_id"] * 5, "text_id"]
        stored = [store_buckets(df, f"measured_{i}", key, 4) for i, (df, key) in enumerate(zip([adv, which, *many, texts], keys, strict=True))]
        rows, sent = [], []
        for out in (wide_postings(*stored).select(*old), wide_postings(*stored, measures=measures).select(*measures)):
            start = shuffled(spark)
            rows.append(sorted(map(str, out.collect())))
            sent.append(shuffled(spark) - start)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows[0] == rows[1] and len(rows[0]) == 3_000
    assert 0 < 2 * sent[1] < sent[0]


def test_relational_texts_are_stored_once(spark, sf_dir):
    from vacanta.plans.catalog_prep import _relational

    _, details, *_, texts = _relational(spark, sf_dir)
    assert details.columns == ["advertisement_id", "text_id"] and texts.columns == ["text_id", "title", "raw_text"]
    assert texts.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_rows_leave_by_their_place(spark):
    """Bits over more than one row of them, and none for a file."""
    path = new_path(spark, "placed")
    spark.range(70_000).coalesce(1).write.parquet(path)
    spark.range(70_000, 70_010).coalesce(1).write.mode("append").parquet(path)
    placed = with_place(spark.read.parquet(path))
    gone = "id % 7 = 3 AND id < 70000 OR id IN (0, 7, 32767, 32768, 69999)"
    kept = _without(placed, _places(placed.where(gone)))
    assert kept.columns == placed.columns
    assert [r.id for r in kept.select("id").orderBy("id").collect()] == [r.id for r in placed.where(f"NOT ({gone})").select("id").orderBy("id").collect()]


def test_long_lists_share_one_shuffle_by_pieces_of_files(spark):
    ads = stage(postings(spark, 100), "ads")
    short = sorted(map(str, prepare(ads).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = prepare(ads)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, out.collect())) == short
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The wide rows once and the two lists.
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("Exchange hashpartitioning(_file#") == 3 and "_firm_id#" in plan
    assert all("_part#" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
