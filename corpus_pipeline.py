"""Corpus pipeline: from documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before it kept, and returns
a DataFrame that is written as Parquet and reread as the next one's docs. All but the last return the
columns of documents, whatever other columns a document has. Null, empty and repeated rows have the
results that the stages' operators define; an empty table passes through as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta.llm import bpe, decontaminate, language_id, minhash, quality
from vacanta.llm.batches import numbered, restored, table
from vacanta.sources.staging import stage

#: Least probability of the predicted language; below it a document is in no known language.
LEAST_LANGUAGE = 0.3
VOCABULARY = "byte_bpe_50k.json"


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts without a letter go."""
    model = language_id.train(docs, key=F.col("doc_id"))
    renamed, text = numbered(docs, "text")
    found = language_id.identify(renamed, model, text)
    return restored(found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)), docs)


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs)
    renamed, text = numbered(docs, "text")
    return restored(quality.score_quality(renamed, model, text).where("accepted"), docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.without_near_duplicates(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no considerable part of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    coded = bpe.encode_texts(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY), decode=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identified),
    ("quality", accepted),
    ("near_duplicates", distinct),
    ("decontamination", uncontaminated),
    ("bpe", encoded),
]

#: None: language, quality and near duplicates come from trained or sampled models. See the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
