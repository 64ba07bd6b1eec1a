"""End-to-end jobs: each reads named tables, writes named results and repeats only what is missing."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta.functions.patterns import Dictionary
from vacanta.operators import reports as rp
from vacanta.operators import triple_lock as tl
from vacanta.operators.dictionary import dictionary_frame
from vacanta.operators.match import match_keywords, match_longest_first, signatures
from vacanta.operators.sweep import elbow_k, keyword_flagged_counts, keyword_report
from vacanta.operators.trend import C_GRID, K_GRID, TrendConfig, keyword_breakeven, keyword_g1, keyword_g2_at_c, keyword_stats_wide
from vacanta.plans.pipeline import calibrate
from vacanta.sources.incremental import process_stale, read_partitioned, writable
from vacanta.sources.io import reconcile, write_report
from vacanta.sources.staging import stage, unstage


def run_export(postings: DataFrame, widen: Callable[[DataFrame], DataFrame], target: str, ts: str) -> DataFrame:
    """Export postings as wide rows, one folder per day; days already complete and unchanged are skipped.

    ``widen`` nests the children of the postings it is given and keeps their number. Only stale
    days are nested; postings without a date are a day of their own. Returns expected, exported,
    complete. Children are not part of what a day is judged by: pass postings that carry a change
    mark of theirs where they change on their own.
    """
    spark = postings.sparkSession
    by_day = postings.withColumn("day", F.to_date(ts))
    process_stale(by_day, _written_partitions(spark, target, by_day, "day"), "day", lambda df: widen(df).hint("rebalance", "day"), target)
    return reconcile(by_day, spark.read.parquet(target))


def run_incremental(source: DataFrame, job: Callable[[DataFrame], DataFrame], target: str, partition: str = "year") -> DataFrame:
    """A row-preserving job over the partitions whose output is missing, short, or of other content.

    Returns the partitions that were redone with their row counts.
    """
    source = writable(source, partition)
    return process_stale(source, _written_partitions(source.sparkSession, target, source, partition), partition, job, target)


def _written_partitions(spark: SparkSession, target: str, source: DataFrame, partition: str) -> DataFrame | None:
    """The partition column of what is written, in the source's type."""
    return read_partitioned(spark, target, source.schema[partition])


@dataclass(frozen=True)
class Pool:
    """Keywords of a calibration and the classified postings it reads."""

    excluded: tuple[str, ...] = ()
    where: str = "true"


def run_calibration(
    classified: DataFrame,
    dictionary: Dictionary,
    target: str,
    pools: Mapping[str, Pool],
    kind: str = "parquet",
    cs: tuple[float, ...] = C_GRID,
    ks: tuple[int, ...] = K_GRID,
    config: TrendConfig = TrendConfig(),
) -> list[str]:
    """Classified postings (year, matches) to the tables of every pool, under ``target``/pool.

    Tables: keyword_stats, breakeven, status, sweep, elbow, keywords_at_c, keyword_report.
    """
    frame = dictionary_frame(classified.sparkSession, dictionary)
    # One pass over the corpus serves all pools.
    marks = {f"in_{name}": F.expr(pool.where) for name, pool in pools.items()}
    sigs = stage(signatures(classified.withColumns(marks), "year", *marks), "signatures")
    paths = []
    for name, pool in pools.items():
        own = sigs.where(F.col(f"in_{name}")).groupBy("year", "matches").agg(F.sum("n_ads").alias("n_ads"))
        run = calibrate(stage(own, "pool"), frame, pool.excluded, cs, config)
        breakeven, sweep = keyword_breakeven(run.trend, config), stage(run.sweep(ks), "sweep")
        g1 = keyword_g1(run.trend, config)
        tables = {
            "keyword_stats": keyword_stats_wide(run.trend, config),
            "breakeven": breakeven,
            "status": run.status,
            "sweep": sweep,
            "elbow": elbow_k(sweep, ks),
            "keywords_at_c": keyword_g2_at_c(run.trend, cs, config),
            "keyword_report": keyword_report(breakeven, g1, keyword_flagged_counts(run.counted, 0, ks, config), frame),
        }
        for table, df in tables.items():
            paths.append(f"{target}/{name}/{table}")
            write_report(df, paths[-1], kind)
    return paths


def run_rules(
    ads: DataFrame, dictionary: Dictionary, counts_path: str, target: str, rules: tl.RuleConfig = tl.RuleConfig(), makers: str = tl.COPILOT_CONTEXT
) -> None:
    """The earlier scoring: ads (ad_id, year, month, language, occupation, text) to scored ads and a group map.

    Monthly counts are kept at ``counts_path``; months that have not changed are not counted again. Writes
    ``target``/scored by year and ``target``/groups; the staged match table is removed at the end.
    """
    matched = match_longest_first(ads, dictionary)
    spark = ads.sparkSession
    kept = ["ad_id", "year", "month", "language", "occupation", "matches"]
    slim = stage(matched.select(*kept, F.lit("").alias("text"), tl.beside_makers("text", makers).alias("makers")), "matched")
    counts = tl.reusable_counts(slim, counts_path, tl.dictionary_digest(dictionary))
    groups = stage(tl.dhs_groups(dictionary_frame(spark, dictionary), counts.select("year", "bucket", "keyword", "n"), rules), "groups")
    sigs = stage(signatures(slim, "year", "occupation"), "signatures")
    dense = stage(tl.intensive_occupations(tl.occupation_intensity(sigs, groups, rules), rules), "dense")
    scored = tl.flag_rules(slim.drop("text"), groups, dense, rules, makers="makers").drop("makers")
    scored.write.mode("overwrite").partitionBy("year").parquet(f"{target}/scored")
    write_report(groups, f"{target}/groups")
    unstage(spark, slim)


#: Report tables of :func:`run_aggregations` over scored postings.
AGGREGATIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "time_series": lambda df: rp.share_of(df, "year"),
    "industry_level": lambda df: rp.share_of(df, "industry"),
    "industry_time_series": lambda df: rp.share_of(df, "industry", "year"),
    "occupation_level": lambda df: rp.share_of(df, "occupation"),
    "firm_level": rp.firm_level,
    "firm_intensity": rp.firm_intensity_top,
    "adoption_index": lambda df: rp.adoption_index(df),
    "group_shares": lambda df: rp.group_share_long(df, "year"),
}


def run_aggregations(scored: DataFrame, target: str, kind: str = "parquet", tables: tuple[str, ...] | None = None) -> list[str]:
    """Report tables of scored postings, one folder each; narrow columns are staged once for all of them."""
    narrow = stage(scored.drop("text", "matches"), "scored")
    paths = []
    for name in tables or tuple(AGGREGATIONS):
        paths.append(f"{target}/{name}")
        write_report(AGGREGATIONS[name](narrow), paths[-1], kind)
    unstage(scored.sparkSession, narrow)
    return paths


def classified_for(dictionary: Dictionary) -> Callable[[DataFrame], DataFrame]:
    """A row-preserving job for :func:`run_incremental`: matches of every posting."""
    return lambda ads: match_keywords(ads, dictionary)

