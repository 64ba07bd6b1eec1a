"""Query of the URL filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacanta.llm.batches import table
from vacanta.llm.urls import Rule, judge_urls, labelled_urls, train_from

#: Rules of the query; fixed values.
RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train_from(spark.createDataFrame(labelled_urls(), "url string, label int"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, RULES, model).select("page_id", "host", "path", "rule", "verdict", "block_score")


QUERIES = {"op6_url_filter": op6_url_filter}
ORACLES: dict[str, str] = {}
