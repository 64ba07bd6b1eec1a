"""Query of the main-text extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta.llm.batches import table
from vacanta.llm.html_text import extract_text


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op3_html_text": op3_html_text}
ORACLES: dict[str, str] = {}
