"""Keyword statistics: yearly counts, pre-period trend, benchmark and break status.

Inputs are match signatures (`operators.match.signatures`): dims, matches, n_ads. A keyword
statistic never touches the corpus again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacanta.functions.numbers import round_even
from vacanta.functions.patterns import LANGUAGES

# Calibration grids.
C_GRID = (0.0, 1.05, 1.1, 1.5, 3.0, 5.0)
K_GRID = (1, 2, 3, 4, 5)


@dataclass(frozen=True)
class TrendConfig:
    start: int = 2016
    end: int = 2020
    validation: int = 2025
    recent: tuple[int, ...] = (2023, 2024, 2025)
    min_recent_hits: int = 1
    min_hits: int = 10
    languages: tuple[str, ...] = LANGUAGES

    @property
    def pre_years(self) -> range:
        return range(self.start, self.end + 1)


def keyword_counts(sigs: DataFrame, *dims: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Ads per (dims, bucket, keyword)."""
    hits = sigs.select(*dims, "n_ads", F.explode("matches").alias("m")).select(
        *dims, "n_ads", "m.bucket", "m.keyword"
    )
    if excluded:
        hits = hits.where(~F.col("keyword").isin(*excluded))
    return hits.groupBy(*dims, "bucket", "keyword").agg(F.sum("n_ads").alias("n"))


def yearly_columns(
    keywords: DataFrame, counts: DataFrame, years: list[int], languages: tuple[str, ...]
) -> DataFrame:
    """Dense (keyword, lang) rows with one count column ``y<year>`` per year, 0 where missing."""
    spine = keywords.select("keyword", F.explode(F.array(*map(F.lit, languages))).alias("lang"))
    wide = (
        counts.where(F.col("year").isin(*years))
        .groupBy("keyword", F.col("bucket").alias("lang"))
        .agg(*[F.sum(F.when(F.col("year") == y, F.col("n"))).alias(f"y{y}") for y in years])
    )
    out = spine.join(wide, ["keyword", "lang"], "left")
    return out.fillna(0, [f"y{y}" for y in years])


def ols(years: list[int], at: int) -> dict[str, Column]:
    """Least squares of the ``y<year>`` columns on year: slope, intercept, fit, residual error.

    x counts from the first year; fewer than two points give zeros. The x values are fixed and all
    sums are of integers, so the result does not depend on the order rows were added up.
    """
    n = len(years)
    x = [y - years[0] for y in years]
    ys = [F.col(f"y{y}").cast("double") for y in years]
    mean = sum(ys[1:], ys[0]) / n
    if n < 2:
        zero = F.lit(0.0)
        return {"slope": zero, "intercept": zero, "yhat": zero, "mean": mean, "se": zero}
    sxx = n * sum(i * i for i in x) - sum(x) ** 2
    sxy = sum((y * float(n * i - sum(x)) for i, y in zip(x, ys)), F.lit(0.0))
    slope = sxy / sxx
    mean_x = sum(x) / n
    intercept = mean - slope * mean_x
    residuals = [y - (intercept + slope * i) for i, y in zip(x, ys)]
    ss = sum((r * r for r in residuals), F.lit(0.0))
    se = F.sqrt(ss / (n - 2)) if n > 2 else F.lit(0.0)
    yhat = intercept + slope * (at - years[0])
    return {"slope": slope, "intercept": intercept, "yhat": yhat, "mean": mean, "se": se}


def keyword_trend(keywords: DataFrame, counts: DataFrame, config: TrendConfig = TrendConfig()) -> DataFrame:
    """Trend and benchmark per (keyword, lang).

    The benchmark B is the larger of the trend extended to the validation year and the pre-period
    mean, never negative.
    """
    pre = list(config.pre_years)
    years = sorted({*pre, *config.recent, config.validation})
    fit = ols(pre, config.validation)
    dense = yearly_columns(keywords, counts, years, config.languages)
    pre_total = sum((F.col(f"y{y}") for y in pre[1:]), F.col(f"y{pre[0]}"))
    recent = [F.col(f"y{y}") for y in config.recent]
    return dense.select(
        "keyword",
        "lang",
        pre_total.alias("pre_total"),
        sum(recent[1:], recent[0]).alias("recent_total"),
        F.col(f"y{config.validation}").alias("y_val"),
        fit["slope"].alias("slope"),
        fit["intercept"].alias("intercept"),
        fit["mean"].alias("mean"),
        fit["yhat"].alias("yhat"),
        F.greatest(fit["yhat"], fit["mean"], F.lit(0.0)).alias("B"),
    )


def _presence() -> list[Column]:
    return [
        F.sum("pre_total").alias("pre_total"),
        F.sum("recent_total").alias("recent_total"),
        F.sum("y_val").alias("y_val_all_langs"),
    ]


def _with_g1(per_keyword: DataFrame, config: TrendConfig) -> DataFrame:
    zero = F.col("pre_total") == 0
    return per_keyword.withColumn("zero_pre", zero).withColumn(
        "is_g1", zero & (F.col("recent_total") >= config.min_recent_hits)
    )


def keyword_g1(trend: DataFrame, config: TrendConfig = TrendConfig()) -> DataFrame:
    """Keywords absent in the pre-period in all languages and present recently."""
    return _with_g1(trend.groupBy("keyword").agg(*_presence()), config)


def qualifies(c: float | Column, config: TrendConfig = TrendConfig()) -> Column:
    """Validation-year count reaches c times the benchmark and the floor, in one language."""
    return (F.col("y_val") >= F.lit(c) * F.col("B")) & (F.col("y_val") >= config.min_hits)


def keyword_status(
    trend: DataFrame, cs: tuple[float, ...] = C_GRID, config: TrendConfig = TrendConfig()
) -> DataFrame:
    """Per keyword: is_g1 and one boolean ``g2_<i>`` per value of ``cs``.

    A language that qualifies makes the whole keyword group 2; group 1 keywords are excluded.
    """
    g2 = [F.bool_or(qualifies(c, config)).alias(f"g2_{i}") for i, c in enumerate(cs)]
    out = _with_g1(trend.groupBy("keyword").agg(*_presence(), *g2), config)
    return out.withColumns({f"g2_{i}": F.col(f"g2_{i}") & ~F.col("is_g1") for i in range(len(cs))})


def keyword_g2_at_c(
    trend: DataFrame, cs: tuple[float, ...] = C_GRID, config: TrendConfig = TrendConfig()
) -> DataFrame:
    """(c, keyword) rows of group 2 keywords per value of ``cs``."""
    status = keyword_status(trend, cs, config)
    rows = F.array(*[F.when(F.col(f"g2_{i}"), F.lit(float(c))) for i, c in enumerate(cs)])
    return status.select(F.explode(F.array_compact(rows)).alias("c"), "keyword")


def multiple() -> Column:
    """Validation-year count over benchmark; infinite for a zero benchmark with hits, else 0."""
    return F.when(F.col("B") > 0, F.col("y_val") / F.col("B")).otherwise(
        F.when(F.col("y_val") > 0, F.lit(float("inf"))).otherwise(0.0)
    )


def keyword_stats_wide(trend: DataFrame, config: TrendConfig = TrendConfig()) -> DataFrame:
    """One row per keyword: benchmark, count and multiple per language, rounded to 2 places."""
    ratio = F.when(F.col("B") > 0, round_even(F.col("y_val") / F.col("B"), 2))
    cells = []
    for lang in config.languages:
        here = F.col("lang") == lang
        cells += [
            F.max(F.when(here, round_even(F.col("B"), 2))).alias(f"B_{lang}"),
            F.max(F.when(here, F.col("y_val"))).alias(f"y_val_{lang}"),
            F.max(F.when(here, ratio)).alias(f"multiple_{lang}"),
        ]
    return _with_g1(trend.groupBy("keyword").agg(*_presence(), *cells), config).drop(
        "pre_total", "recent_total"
    )


def keyword_breakeven(trend: DataFrame, config: TrendConfig = TrendConfig()) -> DataFrame:
    """Language with the highest multiple per keyword, which is the c where the keyword drops out.

    On equal multiples the language listed first wins.
    """
    rank = F.array_position(F.array(*map(F.lit, config.languages)), F.col("lang"))
    best = trend.groupBy("keyword").agg(
        F.max(
            F.struct(
                multiple().alias("breakeven_c"),
                (-rank).alias("_rank"),
                F.col("lang").alias("best_lang"),
                F.col("B").alias("B_best"),
                F.col("y_val").alias("y_val_best"),
                F.col("mean").alias("mean_best"),
            )
        ).alias("best")
    )
    return best.select(
        "keyword", "best.best_lang", "best.breakeven_c", "best.B_best", "best.y_val_best", "best.mean_best"
    )
