"""Aggregate reports over classified or scored postings.

All of them shuffle partial aggregates only. Limits belong to the reports themselves (top n) and
have a unique tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _flag_share(factor: float = 100.0) -> Column:
    return factor * F.col("genai_postings") / F.col("total_postings")


def _totals(flag: str) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_postings"),
        F.count_if(F.col(flag)).alias("genai_postings"),
    ]


def firm_level(df: DataFrame, firm: str = "firm_id", order: tuple[str, ...] = ("created", "id")) -> DataFrame:
    """Per firm: earliest name and size class, postings, flagged postings, group counts, rate."""
    first = F.min(F.struct(*order, "company_name", "size_name"))
    return (
        df.groupBy(firm)
        .agg(
            first.alias("_f"),
            *_totals("genai_flag"),
            F.count_if("group1_match").alias("group1_count"),
            F.count_if("group2_match").alias("group2_count"),
        )
        .withColumn("genai_rate", _flag_share(1.0))
        .select(
            firm,
            F.col("_f.company_name").alias("company_name"),
            F.col("_f.size_name").alias("size_category"),
            "total_postings",
            "genai_postings",
            "group1_count",
            "group2_count",
            "genai_rate",
        )
    )


def share_of(df: DataFrame, *dims: str, flag: str = "genai_flag") -> DataFrame:
    """Postings, flagged postings and percentage per combination of dims."""
    return df.groupBy(*dims).agg(*_totals(flag)).withColumn("genai_percentage", _flag_share())


def share_by(
    df: DataFrame, dim: str, flag: Column, min_n: int = 0, top_n: int | None = None, explode: bool = False
) -> DataFrame:
    """Flagged share by a dimension with minimum support; array dimensions can be exploded."""
    if explode:
        df = df.select(flag.alias("_flag"), F.explode(dim).alias(dim)).where(F.col(dim).isNotNull())
    else:
        df = df.select(flag.alias("_flag"), dim)
    out = (
        df.groupBy(dim)
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("_flag").alias("flagged"))
        .where(F.col("total") >= min_n)
        .withColumn("share", 100.0 * F.col("flagged") / F.col("total"))
    )
    return out if top_n is None else out.orderBy(F.col("share").desc(), dim).limit(top_n)


def adoption_index(
    df: DataFrame, first_year: int = 2012, last_year: int = 2025, threshold: int = 1, firm: str = "firm_id"
) -> DataFrame:
    """Cumulative adopting firms per year and their share of the firms posting that year.

    A firm adopts in the first year with ``threshold`` flagged postings. Adopters before the first
    year of the report are not in its sum. Years without postings have no share.
    """
    firm_years = df.groupBy(firm, "year").agg(F.count_if("genai_flag").alias("n_flagged"))
    # One pass over firm-years: a firm's first adopting year travels with its posting years.
    adopting = F.when(F.col("n_flagged") >= threshold, F.col("year"))
    per_firm = firm_years.groupBy(firm).agg(
        F.min(adopting).alias("adopted"), F.collect_list("year").alias("years")
    )
    events = per_firm.select(
        F.explode(
            F.concat(
                F.transform("years", lambda y: F.struct(y.alias("year"), F.lit(0).alias("a"), F.lit(1).alias("p"))),
                F.when(
                    F.col("adopted").isNotNull(),
                    F.array(F.struct(F.col("adopted").alias("year"), F.lit(1).alias("a"), F.lit(0).alias("p"))),
                ).otherwise(F.array()),
            )
        ).alias("e")
    ).select("e.*")
    per_year = events.groupBy("year").agg(
        F.sum("a").alias("new_adopters"), F.sum("p").alias("total_firms_posting")
    )
    spine = df.sparkSession.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    so_far = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        spine.join(per_year, "year", "left")
        .fillna(0, ["new_adopters", "total_firms_posting"])
        .withColumn("adopting_firms_count", F.sum("new_adopters").over(so_far))
        .withColumn(
            "adoption_share",
            F.try_divide(100.0 * F.col("adopting_firms_count"), F.col("total_firms_posting")),
        )
    )


def firm_intensity_top(
    df: DataFrame, min_postings: int = 5, top_n: int = 20, firm: str = "firm_id", order: tuple[str, ...] = ("created", "id")
) -> DataFrame:
    """Firms with the highest flagged share per year, among those with enough postings."""
    rank = F.row_number().over(
        Window.partitionBy("year").orderBy(F.col("genai_intensity").desc(), F.col(firm))
    )
    return (
        df.groupBy("year", firm)
        .agg(F.min(F.struct(*order, "company_name")).alias("_f"), *_totals("genai_flag"))
        .where((F.col("total_postings") >= min_postings) & (F.col("genai_postings") > 0))
        .withColumn("genai_intensity", _flag_share())
        .withColumn("rank", rank)
        .where(F.col("rank") <= top_n)
        .select(
            "year", firm, F.col("_f.company_name").alias("company_name"),
            "total_postings", "genai_postings", "genai_intensity", "rank",
        )
    )


def keyword_time_series(scored: DataFrame) -> DataFrame:
    """Matches and flagged matches per keyword and year; each flagged one goes to its first rule.

    ``scored``: year, matched_keywords, genai_flag and the four rule flags. Rows are reduced to
    distinct combinations before the keywords are exploded.
    """
    flags = ["genai_flag", "flag_rule_1", "flag_rule_2", "flag_rule_3", "flag_rule_copilot"]
    rows = (
        scored.where(F.size("matched_keywords") > 0)
        .groupBy("year", "matched_keywords", *flags)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("keyword", F.explode("matched_keywords"))
    )
    f, r1, r2, r3, rc = (F.col(c) for c in flags)

    def n(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0))

    return rows.groupBy("keyword", "year").agg(
        F.sum("n").alias("match_count"),
        n(f).alias("flagged_count"),
        n(f & r1).alias("flagged_g1"),
        n(f & r2 & ~r1).alias("flagged_g2"),
        n(f & r3 & ~r1 & ~r2).alias("flagged_g3"),
        n(f & rc & ~r1 & ~r2 & ~r3).alias("flagged_rc"),
    )


def keyword_volume(classified: DataFrame, dictionary: DataFrame, validated: bool | None = None) -> DataFrame:
    """Ads per dictionary keyword by stored best-group matches, 0 for keywords without any."""
    counts = (
        classified.where(F.size("matched_group_keywords") > 0)
        .groupBy("matched_group_keywords")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.explode("matched_group_keywords").alias("keyword"), "n")
        .groupBy("keyword")
        .agg(F.sum("n").alias("ad_match_count"))
    )
    kept = dictionary if validated is None else dictionary.where(F.col("validated") == F.lit(validated))
    return kept.join(counts, "keyword", "left").fillna(0, ["ad_match_count"])


def keyword_coverage(volume: DataFrame, *dims: str) -> DataFrame:
    """Keywords with at least one match out of all, over every combination of dims and totals."""
    return volume.cube(*dims).agg(
        F.count_if(F.col("ad_match_count") > 0).alias("matched"), F.count(F.lit(1)).alias("total")
    )


GROUPS = ("1", "2", "3", "NA")


def group_pivot(df: DataFrame, *dims: str) -> DataFrame:
    """One count column per group, all four always present, with totals and percentages."""
    wide = df.groupBy(*dims).agg(
        *[F.count_if(F.col("group") == g).alias(f"n_{g}") for g in GROUPS],
        F.count(F.lit(1)).alias("total"),
    )
    flagged = F.col("n_1") + F.col("n_2") + F.col("n_3")
    pct = lambda c: 100.0 * c / F.col("total")
    return wide.withColumns(
        {
            **{f"pct_{g}": pct(F.col(f"n_{g}")) for g in GROUPS[:3]},
            "n_any": flagged,
            "pct_any": pct(flagged),
        }
    )


def group_share_long(df: DataFrame, dim: str) -> DataFrame:
    """Group 1 share and any-group share per value of dim, one row per series."""
    wide = group_pivot(df, dim).select(
        dim, F.col("pct_1").alias("Group 1 share"), F.col("pct_any").alias("Any group share")
    )
    return wide.unpivot([dim], ["Group 1 share", "Any group share"], "series", "share_pct")


def top_keywords(classified: DataFrame, n: int = 25) -> DataFrame:
    """Most frequent (keyword, group) pairs."""
    return (
        classified.where(F.col("group") != "NA")
        .groupBy("group", "matched_group_keywords")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("group", "n", F.explode("matched_group_keywords").alias("keyword"))
        .groupBy("keyword", "group")
        .agg(F.sum("n").alias("n_postings"))
        .orderBy(F.col("n_postings").desc(), "keyword", "group")
        .limit(n)
    )


def distinct_adopters(df: DataFrame, firm: str = "firm_id") -> DataFrame:
    """Distinct firms with a flagged posting per year and (year null) overall.

    A missing firm counts as one firm. Firm-years are made distinct first, so a firm with many
    postings is one row per year when firms are counted.
    """
    firm_years = df.where(F.col("group") != "NA").select("year", firm).distinct()
    per_year = firm_years.groupBy("year").agg(F.count(F.lit(1)).alias("adopting_firms"))
    overall = firm_years.select(firm).distinct().agg(F.count(F.lit(1)).alias("adopting_firms"))
    return per_year.unionByName(overall.withColumn("year", F.lit(None).cast("int")))


def language_mix(df: DataFrame, language: str = "language") -> DataFrame:
    """Language shares of all postings and of flagged postings."""
    counts = df.groupBy(language).agg(
        F.count(F.lit(1)).alias("All postings"),
        F.count_if(F.col("group") != "NA").alias("Flagged postings"),
    )
    long = counts.unpivot([language], ["All postings", "Flagged postings"], "scope", "n").where("n > 0")
    total = F.sum("n").over(Window.partitionBy("scope"))
    return long.withColumn("share", 100.0 * F.col("n") / total)


def rate_vs_benchmark(df: DataFrame, flag: Column, from_year: int, benchmark_pct: float) -> DataFrame:
    """Flagged rate since a year against an outside figure."""
    rate = F.coalesce(F.try_divide(100.0 * F.col("flagged"), F.col("total")), F.lit(0.0))
    return (
        df.where(F.col("year") >= from_year)
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(flag).alias("flagged"))
        .withColumn("rate_pct", rate)
        .withColumn("ratio", F.col("rate_pct") / F.lit(benchmark_pct))
    )


def month_of(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM")


def monthly_volume(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(month_of(ts).alias("month")).agg(F.count(F.lit(1)).alias("postings"))


def monthly_boolean_share(df: DataFrame, ts: str, flag: Column) -> DataFrame:
    """Share of true per month; missing values count in the denominator only."""
    return (
        df.groupBy(month_of(ts).alias("month"))
        .agg(F.count(F.lit(1)).alias("postings"), F.count_if(flag).alias("true_postings"))
        .withColumn("share", F.col("true_postings") / F.col("postings"))
    )


def fiscal_composition(df: DataFrame, ts: str, category: Column, first_month: int = 11) -> DataFrame:
    """Category shares per fiscal year starting in ``first_month``; only years with all 12 months."""
    start = F.when(F.month(ts) >= first_month, F.year(ts)).otherwise(F.year(ts) - 1)
    monthly = df.groupBy(start.alias("win"), F.month(ts).alias("month"), category.alias("category")).agg(
        F.count(F.lit(1)).alias("n")
    )
    per_window = Window.partitionBy("win")
    return (
        monthly.groupBy("win", "category")
        .agg(F.sum("n").alias("n"), F.collect_set("month").alias("months"))
        .withColumn("_months", F.size(F.array_distinct(F.flatten(F.collect_list("months").over(per_window)))))
        .where("_months >= 12")
        .withColumn("share", F.col("n") / F.sum("n").over(per_window))
        .select("win", "category", "n", "share")
    )


def share_by_code(df: DataFrame, code: str, flag: Column, min_coded: int = 50, denominator: str = "coded") -> DataFrame:
    """True share per code over coded (or all) rows; codes with too few coded rows drop out."""
    out = (
        df.groupBy(code)
        .agg(
            F.count(F.lit(1)).alias("n_total"),
            F.count_if(flag).alias("n_true"),
            F.count_if(~flag).alias("n_false"),
        )
        .withColumn("n_coded", F.col("n_true") + F.col("n_false"))
        .where(F.col("n_coded") >= min_coded)
    )
    return out.withColumn("share", F.col("n_true") / F.col("n_coded" if denominator == "coded" else "n_total"))


def monthly_two_series(ads: DataFrame, codes: DataFrame, id: str, ts: str, code: str) -> DataFrame:
    """Postings and distinct codes per month; months without codes show 0.

    ``codes``: id, code.
    """
    dated = ads.select(id, F.to_date(F.date_trunc("month", ts)).alias("month"))
    n_ads = dated.groupBy("month").agg(F.count(F.lit(1)).alias("n_ads"))
    n_codes = (
        codes.join(dated, id).select("month", code).distinct().groupBy("month").agg(F.count(code).alias("n_codes"))
    )
    return n_ads.join(n_codes, "month", "full_outer").fillna(0, ["n_codes"])


def supported_languages(df: DataFrame, language: str = "language", more_than: int = 100) -> DataFrame:
    """Languages with more than a minimum number of postings, without "unknown"."""
    return (
        df.groupBy(language)
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > more_than) & (F.col(language) != "unknown"))
    )
