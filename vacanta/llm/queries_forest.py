"""Query of the near-duplicate search over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta.llm.batches import table
from vacanta.llm.forest import near_embeddings


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


QUERIES = {"op2_embedding_dedup": op2_embedding_dedup}
ORACLES: dict[str, str] = {}
