"""Query of spelling variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacanta.llm.batches import table
from vacanta.llm.spelling import spelling_variants


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op13_spelling": op13_spelling}
ORACLES: dict[str, str] = {}
