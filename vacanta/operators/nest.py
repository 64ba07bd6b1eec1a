"""Nesting of relational children into wide postings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Child:
    """One-to-many child table to nest as an array column.

    ``distinct`` collects distinct values. Arrays are sorted, so the result does not depend on
    the order rows arrive in.
    """

    table: DataFrame
    key: str
    value: Column
    name: str
    distinct: bool = False


def nest_children(parent: DataFrame, key: str, children: list[Child]) -> DataFrame:
    """Left join each child as an array, empty when there is none.

    Children are aggregated before the join, so their sizes never multiply, and every join is one
    to one on the same key: the parent is shuffled once for all of them.
    """
    out = parent
    for c in children:
        collect = F.collect_set if c.distinct else F.collect_list
        # Children without a key have no parent; together they would be one large array.
        arrays = c.table.where(F.col(c.key).isNotNull()).groupBy(F.col(c.key).alias(key)).agg(
            F.array_sort(collect(c.value)).alias(c.name)
        )
        empty = F.array().cast(arrays.schema[c.name].dataType)
        out = out.join(arrays, key, "left").withColumn(c.name, F.coalesce(c.name, empty))
    return out


def wide_postings(
    advertisements: DataFrame,
    details: DataFrame,
    metadata: DataFrame,
    country: DataFrame,
    canton: DataFrame,
    company_metadata: DataFrame,
    texts: DataFrame | None = None,
    measures: dict[str, Column] | None = None,
) -> DataFrame:
    """The wide posting table from its six relational sources.

    Where texts lie in a table of their own (``texts``: text_id, title, raw_text), ``details`` tells which one
    an advertisement has (advertisement_id, text_id). Everything else is then nested first: rows meet their
    texts last, in the order of these, and no text is shuffled with an advertisement.

    ``measures`` are further columns over ``occupations``, ``locations``, ``cantons_bonus`` and ``industries``
    (the company's metadata). They are taken before rows meet their texts, so a query that selects them
    and not the arrays does not shuffle these.
    """
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    place = F.struct(
        "country",
        F.lit(None).cast("string").alias("province"),
        F.lit(None).cast("int").alias("district"),
        F.lit(None).cast("string").alias("postal_code"),
    )
    title_jobs = metadata.where("type = 'JOB' AND source = 'TITLE' AND name IS NOT NULL")
    industries = company_metadata.where("type = 'INDUSTRY'")
    of_details = ("title", "raw_text") if texts is None else ("text_id",)
    ads = advertisements.join(details.withColumnRenamed("advertisement_id", "id").select("id", *of_details), "id")
    nested = nest_children(
        ads,
        "id",
        [
            Child(title_jobs, "advertisement_id", F.struct(F.col("metadata_id").alias("id"), "name"), "occupations"),
            Child(country, "advertisement_id", place, "locations"),
            Child(canton, "advertisement_id", F.col("canton"), "cantons_bonus", distinct=True),
            Child(
                industries,
                "advertisement_id",
                F.struct(F.col("metadata_id").alias("id"), "name", "type"),
                "industries",
            ),
        ],
    )
    measures = measures or {}
    nested = nested.withColumns(measures)
    if texts is not None:
        nested = nested.join(texts.select("text_id", "title", "raw_text"), "text_id")
    address = "array<struct<country:string,city:string,postal_code:string,street:string,is_primary:boolean>>"
    company = F.struct(
        F.col("company_id").alias("id"),
        F.col("company_name").alias("name"),
        F.col("company_uid").alias("bfs_uid"),
        F.col("company_crn").alias("crn"),
        F.col("industries").alias("metadata"),
        F.array().cast(address).alias("addresses"),
        F.struct(
            F.col("company_size_id").alias("id"),
            F.col("company_size_name").alias("name"),
            F.struct(
                F.col("company_size_min").alias("minimum"), F.col("company_size_max").alias("maximum")
            ).alias("employees"),
        ).alias("size"),
        F.col("company_url").alias("url"),
        F.col("company_recruitment_agency").alias("is_recruiter"),
    )
    return nested.select(
        F.col("duplicategroup").alias("duplicate_group"),
        "title",
        "url",
        "created",
        F.date_format("created", stamp).alias("tst_created"),
        F.date_format("deleted", stamp).alias("tst_deleted"),
        "language",
        F.lit(None).cast("double").alias("duration"),
        F.col("temporary").alias("is_temporary"),
        F.col("homeoffice").alias("has_homeoffice"),
        F.struct(
            F.col("workquota_minimum").alias("minimum"), F.col("workquota_maximum").alias("maximum")
        ).alias("work_quota"),
        F.lit(None).cast("string").alias("location"),
        "locations",
        "cantons_bonus",
        F.col("raw_text").alias("content_clean"),
        "origin",
        company.alias("company"),
        "occupations",
        *measures,
    )
