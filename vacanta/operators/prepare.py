"""Flattening and filtering of wide postings."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacanta.schema import ColumnMap, PrepareConfig, has_field


def parse_timestamp(text: Column) -> Column:
    """Timestamp from text with optional fractional seconds and trailing " UTC"."""
    return F.to_timestamp(F.regexp_replace(text, " UTC$", ""))


def first_tag_name(tags: Column, tag_type: str = "INDUSTRY") -> Column:
    """Name of the first array element of a type; null if there is none."""
    return F.get(F.filter(tags, lambda t: t["type"] == tag_type), F.lit(0))["name"]


def first_name(items: Column) -> Column:
    return F.get(items, F.lit(0))["name"]


def flatten_company(ads: DataFrame, columns: ColumnMap = ColumnMap()) -> DataFrame:
    """Lift the firm attributes out of the company struct, parse the date, drop the struct.

    A missing size struct becomes "unknown", missing tags a null industry.
    """
    c = columns
    company = F.col(c.company)
    if has_field(ads.schema, f"{c.company}.{c.size}"):
        size_id = company[c.size][c.size_id].cast("string")
        size_name = company[c.size][c.size_name]
    else:
        size_id = size_name = F.lit("unknown")
    if has_field(ads.schema, f"{c.company}.{c.metadata}"):
        industry = first_tag_name(company[c.metadata])
    else:
        industry = F.lit(None).cast("string")
    return ads.withColumns(
        {
            c.date: parse_timestamp(F.col(c.date)),
            "_firm_id": company[c.company_id],
            "_company_name": company[c.company_name],
            "_is_recruiter": company[c.is_recruiter],
            "_size_id": size_id,
            "_size_name": size_name,
            "_industry": industry,
        }
    ).drop(c.company)


def any_element(ads: DataFrame, array: str, field: str, value: str) -> DataFrame:
    """Keep rows with any array element whose field has the value; a null array drops the row."""
    return ads.where(F.exists(array, lambda x: x[field] == value))


def date_range(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Both ends inclusive by date; an open end when None.

    Stated on the timestamp itself, so that the bounds reach the file scan.
    """
    if start:
        df = df.where(F.col(column) >= F.to_timestamp(F.lit(start)))
    if end:
        df = df.where(F.col(column) < F.to_timestamp(F.date_add(F.to_date(F.lit(end)), 1)))
    return df


def text_date_bounds(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """A wider date range on timestamps stored as text, which reaches the file scan.

    "YYYY-MM-DD HH:MM:SS" sorts by time as text. The range is a day wider on either side, so the
    exact filter on the parsed time decides. Columns of another type and open ends are left alone.
    """
    if column not in df.columns or df.schema[column].dataType.simpleString() != "string":
        return df
    if start:
        df = df.where(F.col(column) >= str(date.fromisoformat(start[:10]) - timedelta(days=1)))
    if end:
        df = df.where(F.col(column) < str(date.fromisoformat(end[:10]) + timedelta(days=3)))
    return df


def half_open(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    ts = F.col(column)
    return df.where((ts >= F.to_timestamp(F.lit(start))) & (ts < F.to_timestamp(F.lit(end))))


def exclude_size(df: DataFrame, size_id: str, column: str = "_size_id", strict_nulls: bool = False) -> DataFrame:
    """Drop one size class. Unknown sizes stay unless ``strict_nulls`` asks for the old rule."""
    if strict_nulls:
        return df.where(F.col(column) != size_id)
    return df.where(~F.col(column).eqNullSafe(size_id))


def allow_languages(df: DataFrame, languages: tuple[str, ...] | None, source: str = "language") -> DataFrame:
    """Tag the language and keep the listed ones; null and unlisted codes are dropped."""
    df = df.withColumn("detected_language", F.col(source))
    return df if not languages else df.where(F.col("detected_language").isin(*languages))


def flatten_and_filter(ads: DataFrame, config: PrepareConfig = PrepareConfig()) -> DataFrame:
    """Flatten, then country, date, recruiter and size filters."""
    c = config.columns
    out = flatten_company(text_date_bounds(ads, c.date, config.date_start, config.date_end), c)
    if config.country:
        out = any_element(out, c.locations, "country", config.country)
    out = date_range(out, c.date, config.date_start, config.date_end)
    if config.exclude_recruiters:
        out = out.where(F.col("_is_recruiter") == F.lit(False))
    if config.exclude_size_id:
        out = exclude_size(out, config.exclude_size_id, strict_nulls=config.strict_nulls)
    return out


def drop_secondary_tag(tags: Column, tag_id: int, strict_ids: bool = True) -> Column:
    """Remove a tag that is only trusted when it stands alone.

    One tag or none, or no other tag beside it: unchanged. With ``strict_ids`` an id that is not a
    number, met before any other tag, also leaves the array unchanged; without, such ids are
    ignored.
    """
    rest = F.filter(tags, lambda t: ~t["id"].try_cast("int").eqNullSafe(F.lit(tag_id)))
    if strict_ids:
        beside = F.get(rest, F.lit(0))["id"].try_cast("int").isNotNull()
    else:
        beside = F.exists(rest, lambda t: t["id"].try_cast("int").isNotNull())
    return F.when((F.size(tags) > 1) & beside, rest).otherwise(tags)


def drop_ambiguous(df: DataFrame, array: str, most: int = 5) -> DataFrame:
    """Drop rows with more than ``most`` tags; rows without tags stay."""
    return df.where(F.coalesce(F.size(array), F.lit(0)) <= most)


def drop_ambiguous_ids(tags: DataFrame, key: str, most: int = 5) -> DataFrame:
    """Long form of :func:`drop_ambiguous`: drop all rows of ids with more than ``most`` rows."""
    crowded = tags.groupBy(key).count().where(F.col("count") > most).select(key)
    return tags.join(crowded, key, "left_anti")
