"""Query of embedding whitening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta.llm.batches import table
from vacanta.llm.whitening import whiten


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    deviation = F.col("deviation").try_cast("long").alias("deviation")  # null beyond 64 bits
    return found.select(F.col("id").alias("vec_id"), "component", "n", deviation, "whitened", "explained", "identity_error")


QUERIES = {"op11_whitening": op11_whitening}
ORACLES: dict[str, str] = {}
