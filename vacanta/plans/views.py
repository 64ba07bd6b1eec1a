"""Posting-shaped views over the star-schema test tables, and a dictionary for their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta.functions.patterns import Dictionary, Keyword


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ads with text: one per document, dated 2016 to 2025, Italian relabelled from Spanish."""
    doc = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return docs.select(
        doc.alias("ad_id"),
        "text",
        F.when((F.col("lang") == "es") & (doc % 2 == 1), "it").otherwise(F.col("lang")).alias("language"),
        (2016 + doc % 10).cast("int").alias("year"),
        (1 + F.floor(doc / 10) % 12).cast("int").alias("month"),
        F.col("source").alias("occupation"),
    )


def order_group() -> Column:
    return (
        F.when(F.col("o_orderpriority") == "1-URGENT", "1")
        .when(F.col("o_orderpriority") == "2-HIGH", "2")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "3")
        .otherwise("NA")
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings without text: orders with the firm, size class and industry of their customer."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    orders = table(spark, sf_dir, "orders")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("firm_id"),
        F.col("c_name").alias("company_name"),
        F.col("c_mktsegment").alias("size_id"),
        F.col("c_mktsegment").alias("size_name"),
        F.col("c_mktsegment").alias("industry"),
        F.col("c_nationkey").alias("nation"),
        F.col("o_orderdate").alias("created"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("occupation"),
        order_group().alias("group"),
        (order_group() == "1").alias("genai_flag"),
        (order_group() == "1").alias("group1_match"),
        (order_group() == "2").alias("group2_match"),
    )


def lines_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as dated rows with a partly missing duplicate key."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_partkey") % 41 != 0, F.col("l_partkey")).alias("duplicate_group"),
        F.col("l_shipdate").alias("created"),
        F.year("l_shipdate").alias("year"),
        "l_returnflag",
    )


def _kw(keyword, group, source, validated, en, de=None, fr=None, it=None) -> Keyword:
    forms = {"en": en, "de": de or en, "fr": fr or en, "it": it or en}
    return Keyword(keyword, group, source, forms, validated)


# Words of the generated test corpus. They cover: terms that appear late in every language, a
# local form equal to the English one, umlauts and accents, phrases, a phrase inside a longer
# phrase, a form ending in "s", a form of three letters and a term without any match.
TEST_DICTIONARY = Dictionary(
    keywords=(
        _kw("Late Signal", 1, "St", True, "reshst", "enstue", "echen", "gall"),
        _kw("Ndtiea", 1, "St", True, "ndtiea"),
        _kw("Awhlyha", 1, "H&L", True, "awhlyha", "enzuung", "reeuxch", "tata"),
        _kw("Thesated", 1, "LLM", False, "thesated"),
        _kw("Onwhin", 2, "St", True, "onwhin", "teeiner", "leequee", "osiell"),
        _kw("Attion", 2, "St", True, "attion to", "sch der", "de la", "rancion arar"),
        _kw("Tition", 2, "St", True, "Tition", "Ungen", "aux", "nque"),
        _kw("Atan", 2, "H&L", True, "atan", "nicht", "qui", "raie"),
        _kw("Hest", 2, "H&L", True, "hest", "für", "éier", "esra"),
        _kw("Eded", 2, "LLM", False, "eded", "sich", "Èment", "oses"),
        _kw("Tion", 2, "St", True, "tion", "enheit", "tion", "ción"),
        _kw("Tion-Of", 3, "LLM", False, "tion-of", "der des", "la tion", "de ción"),
        _kw("Anin", 2, "LLM", False, "anin", "ente", "enment", "que de"),
        _kw("Thble", 3, "H&L", True, "thble", "erung", "ouon", "esja"),
        _kw("Thly", 3, "LLM", False, "thly", "chein", "oique", "jaado"),
        _kw("Erhe", 3, "LLM", False, "erhe", "enge", "ench", "rancion"),
        _kw("Of The", 3, "H&L", True, "of the", "von der", "la des", "la de"),
        _kw("Ones", 3, "St", True, "ones", "heit", "eaux", "los de"),
        _kw("And Attion", 3, "St", True, "and attion to", "enau sch der", "et de la", "el de"),
        _kw("Eror", 3, "H&L", True, "eror", "erpf", "aipa", "esado"),
        _kw("Heou", 3, "LLM", False, "heou", "Geer", "eetion", "domi"),
        _kw("Ing", 3, "LLM", False, "ing", "zur", "oui", "cos"),
        _kw("Copilot", 2, "St", True, "heed", "einbe", "ouvi", "osar"),
        _kw("Zzyzx Quux", 3, "LLM", False, "zzyzx quux", "zzyzx quuxe", "zzyzx quuxa", "zzyzx quuxo"),
    ),
    extra_forms={"de": {"Tition": ("Heiten",), "Eded": ("Zur",)}, "it": {"Eror": ("Asmente",)}},
)
