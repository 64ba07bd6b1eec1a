"""Occupation crosswalks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacanta.functions.numbers import round_even


def two_hop(
    first: DataFrame,
    second: DataFrame,
    titles: DataFrame,
    id: str = "id",
    mid: str = "mid",
    code: str = "code",
    catalogue: str = "catalogue",
    name: str = "name",
    title: str = "title",
) -> DataFrame:
    """One code and label per id over an intermediate code.

    ``first``: id, name, mid, catalogue; the newest catalogue wins, then the smallest code.
    ``second``: mid, code; ``titles``: code, title. The label is the title, else the name.
    """
    newest = Window.partitionBy(id).orderBy(F.col(catalogue).desc(), F.col(mid))
    picked = first.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")
    smallest = Window.partitionBy(id).orderBy(code)
    mapped = (
        picked.join(second, mid)
        .withColumn("_rn", F.row_number().over(smallest))
        .where("_rn = 1")
        .join(titles, code, "left")
    )
    return mapped.select(id, code, F.coalesce(title, name).alias("label"))


def many_to_many(
    tags: DataFrame, first: DataFrame, second: DataFrame, id: str, tag: str, mid: str = "mid", code: str = "code"
) -> DataFrame:
    """Distinct (id, code) over a many-to-many crosswalk; tags without a mid code drop out.

    The two maps are joined first, so the tag table meets each (tag, code) once and is not
    multiplied by the mid codes.
    """
    codes = first.select(tag, mid).join(second.select(mid, code), mid).select(tag, code).distinct()
    return tags.select(id, tag).distinct().join(codes, tag).select(id, code).distinct()


def unmatched_rate(tags: DataFrame, first: DataFrame, second: DataFrame, tag: str, mid: str = "mid") -> DataFrame:
    """Percentage of joined tag rows without a mid code. Counts per tag first, then joins."""
    known = first.join(second.select(mid), mid, "left_semi").groupBy(tag).agg(F.count(F.lit(1)).alias("k"))
    per_tag = tags.groupBy(tag).agg(F.count(F.lit(1)).alias("n"))
    rows = F.col("n") * F.coalesce(F.col("k"), F.lit(1))
    return per_tag.join(known, tag, "left").agg(
        F.sum(rows).alias("n_rows"),
        round_even(
            F.try_divide(100.0 * F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(0)), F.sum(rows)), 2
        ).alias("pct_unmatched"),
    )


def rolled_up(code: Column) -> Column:
    """Parent of an integer code: its last digit removed."""
    return F.floor(code / 10).cast("int")


def occupation_share(
    df: DataFrame, codes: DataFrame, flag: Column, tags: str = "occupations", min_n: int = 20, top_n: int = 20
) -> DataFrame:
    """Flagged share per mapped occupation code, with a warning on high shares of small samples.

    ``codes``: id, code, label. Tags with an id outside ``codes`` are ignored.
    """
    exploded = df.select(flag.alias("_flag"), F.explode(tags).alias("_tag")).select(
        "_flag", F.col("_tag")["id"].try_cast("long").alias("id")
    )
    share = F.col("flagged_ads") / F.col("total_ads")
    return (
        exploded.groupBy("id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("_flag").alias("f"))
        .join(codes, "id")
        .groupBy("code", "label")
        .agg(F.sum("n").alias("total_ads"), F.sum("f").alias("flagged_ads"))
        .where(F.col("total_ads") >= min_n)
        .withColumn("share", share)
        .withColumn("small_sample", (share > 0.5) & (F.col("total_ads") < 100))
        .orderBy(F.col("share").desc(), "code", "label")
        .limit(top_n)
    )
