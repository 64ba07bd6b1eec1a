"""Query of the chat formatter and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta.llm.batches import table
from vacanta.llm.chat import format_conversations, masked_texts, parse_turns

#: Text of both turns of the additional conversation -7, a fixed value.
CONTROL = r"\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    out = format_conversations(turns.unionByName(extra))
    read = out.select(
        "conv_id",
        F.col("formatted"),
        parse_turns(F.col("formatted")).alias("_turns"),
        F.array_join(masked_texts(F.col("formatted"), F.col("loss_spans")), "").alias("_loss"),
    )
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op4_chat_format": op4_chat_format}

ORACLES = {
    "op4_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), m AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS k,
    length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h')) AS n_text,
    length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c')) AS n_role
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_text + 7 + CASE WHEN before IS NULL OR before <> role THEN n_role + 6 ELSE 0 END)
    + sum(CASE WHEN before <> role THEN 1 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
}
