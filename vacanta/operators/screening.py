"""Statistical screening, sampling and diagnostics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacanta.functions.numbers import round_even
from vacanta.functions.text import preview

# Standard normal quantile per two-sided significance.
Z_BY_ALPHA = {
    0.10: 1.645, 0.05: 1.96, 0.025: 2.24, 0.01: 2.576, 0.005: 2.807, 0.002: 3.09, 0.001: 3.29,
}
DEFAULT_Z = 1.96


def outlier_firm_years(
    postings: DataFrame,
    alpha_by_size: Mapping[str, float],
    fallback_alpha: float = 0.01,
    firm: str = "firm_id",
    size: str = "size_id",
    year: str = "year",
) -> DataFrame:
    """Firm-years with more postings than a log-normal upper bound for their year and size class.

    The bound is exp(mean + z * sample std) - 1 of ln(n + 1). Firms without a size class and
    classes of one firm are never flagged. The statistics are one row per year and class, so they
    are aggregated and joined back instead of sorting all firms of a class in one task.
    """
    return outliers_of_counts(firm_year_counts(postings, firm, size, year), alpha_by_size, fallback_alpha, firm, size, year)


def firm_year_counts(postings: DataFrame, firm: str = "firm_id", size: str = "size_id", year: str = "year") -> DataFrame:
    """Postings per firm, size class and year; firms without a size class are left out."""
    return postings.where(F.col(size).isNotNull()).groupBy(firm, size, year).agg(F.count(F.lit(1)).alias("n_postings"))


def outliers_of_counts(
    counts: DataFrame,
    alpha_by_size: Mapping[str, float],
    fallback_alpha: float = 0.01,
    firm: str = "firm_id",
    size: str = "size_id",
    year: str = "year",
) -> DataFrame:
    """:func:`outlier_firm_years` from :func:`firm_year_counts`."""

    def z_of(alpha: float) -> float:
        return Z_BY_ALPHA.get(round(alpha, 3), DEFAULT_Z)

    z = F.lit(z_of(fallback_alpha))
    for size_id, alpha in alpha_by_size.items():
        z = F.when(F.col(size) == size_id, z_of(alpha)).otherwise(z)
    counts = counts.withColumn("log_n", F.log(F.col("n_postings") + 1))
    stats = counts.groupBy(year, size).agg(
        F.avg("log_n").alias("mean_log"), F.stddev_samp("log_n").alias("std_log")
    )
    upper = F.exp(F.col("mean_log") + z * F.col("std_log")) - 1
    return (
        counts.join(stats, [year, size])
        .withColumn("upper", upper)
        # Equal counts in a class give a bound of exactly n: rounding must not decide there.
        .where(F.col("n_postings") - F.col("upper") > 1e-9 * F.col("n_postings"))
        .select(firm, size, year, "n_postings", "upper")
    )


def drop_outlier_firm_years(
    postings: DataFrame, outliers: DataFrame, firm: str = "firm_id", year: str = "year"
) -> DataFrame:
    """Remove all postings of flagged firm-years; postings without a firm stay."""
    return postings.join(outliers.select(firm, year).distinct(), [firm, year], "left_anti")


def class_counts(df: DataFrame, column: str = "group") -> DataFrame:
    """Rows and percentage per class."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", 100.0 * F.col("n") / total)


def sample_per_group(
    df: DataFrame, group: str, key: str, n: int = 5, seed: int = 42, text: str | None = None
) -> DataFrame:
    """A fixed random sample of ``n`` rows per group, the same on every run.

    Keys are drawn first, so wide rows are not sorted; a repeated key is cut to ``n`` afterwards.
    """
    draw = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    window = Window.partitionBy(group).orderBy(draw, key)

    def first_n(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")

    # Null groups are groups, which only a null-safe join finds again.
    drawn = first_n(df.select(group, key)).distinct().select(F.col(group).alias("_group"), F.col(key).alias("_key"))
    same = F.col(group).eqNullSafe(F.col("_group")) & F.col(key).eqNullSafe(F.col("_key"))
    out = first_n(df.join(drawn, same, "left_semi"))
    return out if text is None else out.withColumn("preview", preview(F.col(text)))


def three_valued(flag: Column, yes: str, no: str, missing: str) -> Column:
    return F.when(flag, yes).when(~flag, no).otherwise(missing)


def flag_diagnostics(df: DataFrame, flag: str, cell: str, min_coded: int = 50) -> DataFrame:
    """Missing, true and false shares of a flag and the cells with too few coded rows, long form.

    Rows: metric and value.
    """
    f = F.col(flag)
    per_cell = df.groupBy(cell).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(f).alias("t"), F.count_if(~f).alias("f")
    )
    coded = F.col("t") + F.col("f")
    below = coded < min_coded
    wide = per_cell.agg(
        F.sum("n").alias("n_rows"),
        (F.sum("n") - F.sum(coded)).alias("n_missing"),
        F.sum("t").alias("n_true"),
        F.sum("f").alias("n_false"),
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(below).alias("n_cells_below"),
        F.coalesce(F.sum(F.when(below, coded)), F.lit(0)).alias("coded_in_dropped_cells"),
        F.sum(coded).alias("total_coded"),
    )

    def pct(part: str, whole: str, digits: int) -> Column:
        return round_even(F.try_divide(100.0 * F.col(part), F.col(whole)), digits)

    wide = wide.withColumns(
        {
            "pct_missing": pct("n_missing", "n_rows", 2),
            "pct_true": pct("n_true", "n_rows", 2),
            "pct_false": pct("n_false", "n_rows", 2),
            "pct_cells_below": pct("n_cells_below", "n_cells", 1),
        }
    )
    names = wide.columns
    return wide.select([F.col(c).cast("double").alias(c) for c in names]).unpivot(
        [], names, "metric", "value"
    )


def match_rate(joined: DataFrame, matched: str) -> DataFrame:
    """Percentage of rows a left join left without a partner."""
    return joined.agg(
        F.count(F.lit(1)).alias("n_rows"),
        round_even(100.0 * F.avg(F.col(matched).isNull().cast("double")), 2).alias("pct_unmatched"),
    )


# Generic terms and terms with an unrelated everyday meaning.
GENERIC_TERMS = (
    "Artificial Intelligence", "Machine Learning", "Neural Networks", "Chatbot",
    "Deep Learning", "Digital Transformation", "Natural Language Processing",
    "Virtual Assistant", "Intelligent Automation", "AI Strategy", "AI-Powered",
)
AMBIGUOUS_TERMS = ("Transformer", "Falcon", "Jasper", "Fine-Tuning", "Prompt Engineer")


def false_positive_screen(
    volumes: DataFrame,
    generic: tuple[str, ...] = GENERIC_TERMS,
    ambiguous: tuple[str, ...] = AMBIGUOUS_TERMS,
    high_pct: float = 2.0,
) -> DataFrame:
    """Unvalidated keywords worth a second look, with the reasons.

    ``volumes``: keyword, group, validated, ad_match_count. High volume is a reason only for terms
    on neither list.
    """
    share = F.try_divide(
        100.0 * F.col("ad_match_count"), F.sum("ad_match_count").over(Window.partitionBy())
    )
    is_generic = F.col("keyword").isin(*generic) if generic else F.lit(False)
    is_ambiguous = F.col("keyword").isin(*ambiguous) if ambiguous else F.lit(False)
    high = ~is_generic & ~is_ambiguous & (F.col("ad_match_count") > 0) & (F.col("share_pct") > high_pct)
    reasons = F.concat_ws(
        "; ",
        F.when(is_generic, "generic term"),
        F.when(is_ambiguous, "ambiguous term"),
        F.when(high, "high volume"),
    )
    return (
        volumes.withColumn("share_pct", F.coalesce(share, F.lit(0.0)))
        .where(~F.col("validated"))
        .withColumn("reason", reasons)
        .where(F.col("reason") != "")
        .select("keyword", "group", "ad_match_count", "share_pct", "reason")
    )
