"""End-to-end jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacanta.functions.patterns import Dictionary
from vacanta.operators.dedup import dedup_within_year
from vacanta.operators.match import classify_group, match_keywords
from vacanta.operators.prepare import allow_languages, flatten_and_filter
from vacanta.operators.screening import drop_outlier_firm_years, firm_year_counts, outliers_of_counts
from vacanta.operators.sweep import grid_sweep, with_status_counts
from vacanta.operators.trend import C_GRID, K_GRID, TrendConfig, keyword_counts, keyword_status, keyword_trend
from vacanta.schema import PrepareConfig
from vacanta.sources.io import write_by
from vacanta.sources.staging import stage


#: Where a row of a table of files is: its name for later passes.
_PLACE = ("_file", "_row")


def with_place(ads: DataFrame) -> DataFrame:
    """``ads`` with the file and the number in it of every row.

    A plan that is no scan of Parquet files is staged first, which writes it once; a shuffle would
    write it as well.
    """
    try:
        return ads.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    except AnalysisException:
        return with_place(stage(ads, "ads"))


def _places(rows: DataFrame) -> DataFrame:
    """The places of ``rows`` as bits, 32,768 places of a file to a row."""
    place = F.col("_row") + 1
    return rows.groupBy("_file", F.bitmap_bucket_number(place).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))


def _without(df: DataFrame, *lists: DataFrame) -> DataFrame:
    """``df`` without the rows at the places of the lists; rows of a file that lie together stay together."""
    place = F.col("_row") + 1
    at = F.bitmap_bit_position(place)
    out = df.withColumn("_part", F.bitmap_bucket_number(place))
    listed = F.lit(False)
    for i, places in enumerate(lists):
        bits = f"_bits_{i}"
        out = out.join(places.withColumnRenamed("_bits", bits), ["_file", "_part"], "left")
        byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        listed = listed | F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return out.where(~listed).select(*df.columns)


def prepare(ads: DataFrame, config: PrepareConfig = PrepareConfig()) -> DataFrame:
    """Wide postings to clean ones: filter, keep the first copy per year, drop outlier firm-years.

    Languages are restricted last. Which rows stay is found out on narrow ones, without any text: key,
    date, URL, firm, size class and the place of the row. The first copy per year and key is chosen
    among these, firm-years are counted and screened on them, and the wide rows lose what is on two
    short lists, places of copies and of outlier firm-years. The lists are bits, one for a row of the
    table. Both are staged, so joins know their true sizes, and wide rows are not shuffled unless a list
    is too long to send around; then both lists take the same shuffle, by pieces of files. Which copy
    stays is settled by date, URL and place in the table, so every pass and every retry picks the same one.
    """
    c = config.columns
    flat = flatten_and_filter(with_place(ads), config).withColumn("year", F.year(c.date))
    tie = [x for x in ("url",) if x in flat.columns]
    narrow = stage(flat.select("year", c.job_id, c.date, *tie, "_firm_id", "_size_id", *_PLACE), "narrow")
    unique = stage(dedup_within_year(narrow, c.job_id, [c.date, *tie, *_PLACE]).select("year", "_firm_id", "_size_id", *_PLACE), "unique")
    copies = stage(_places(narrow.select(*_PLACE).join(unique.select(*_PLACE), [*_PLACE], "left_anti")), "copies")
    counts = stage(firm_year_counts(unique, "_firm_id", "_size_id"), "firm-years")
    outliers = stage(
        outliers_of_counts(counts, dict(config.size_alpha), config.fallback_alpha, "_firm_id", "_size_id"), "outliers"
    )
    usual = drop_outlier_firm_years(unique, outliers, "_firm_id").select(*_PLACE)
    outlying = stage(_places(unique.select(*_PLACE).join(usual, [*_PLACE], "left_anti")), "outlying")
    clean = _without(flat, copies, outlying)
    keys = ["_firm_id", "year"]
    clean = clean.select(*keys, *[x for x in clean.columns if x not in (*keys, *_PLACE)])
    return allow_languages(clean, config.languages, c.language)


def classify(prepared: DataFrame, dictionary: Dictionary, config: PrepareConfig = PrepareConfig()) -> DataFrame:
    """Group and trigger keywords per posting; the full match list is kept for the statistics."""
    c = config.columns
    matched = match_keywords(prepared, dictionary, c.content, "detected_language")
    return classify_group(matched).withColumn("ad_id", F.col(c.job_id))


def run(ads: DataFrame, dictionary: Dictionary, target: str, config: PrepareConfig = PrepareConfig()) -> None:
    """Prepare, classify and write by year."""
    write_by(classify(prepare(ads, config), dictionary, config), target, "year")


@dataclass(frozen=True)
class Calibration:
    """Keyword statistics of one pool, and the signatures counted by them."""

    trend: DataFrame
    status: DataFrame
    counted: DataFrame
    cs: tuple[float, ...]
    config: TrendConfig

    def sweep(self, ks: tuple[int, ...] = K_GRID) -> DataFrame:
        return grid_sweep(self.counted, self.status, self.cs, ks, self.config)


def calibrate(
    sigs: DataFrame,
    keywords: DataFrame,
    excluded: tuple[str, ...] = (),
    cs: tuple[float, ...] = C_GRID,
    config: TrendConfig = TrendConfig(),
) -> Calibration:
    """Rate the keywords of a pool from staged match signatures (year, matches, n_ads).

    The corpus is read once for any number of pools. The trend has a few rows per keyword and is
    staged too, as every status lookup reads it again.
    """
    names = keywords.where(~F.col("keyword").isin(*excluded)) if excluded else keywords
    trend = keyword_trend(names, keyword_counts(sigs, "year", excluded=excluded), config)
    trend = stage(trend, "trend")
    status = keyword_status(trend, cs, config)
    return Calibration(trend, status, with_status_counts(sigs, status, len(cs), excluded), cs, config)
