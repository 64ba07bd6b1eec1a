"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacanta.llm.batches import table
from vacanta.llm.quality import score_quality, train


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, train(docs)).select("doc_id", "quality", "labels", "accepted")


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
