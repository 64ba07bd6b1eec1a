"""Keyword dictionary construction from lists and translations."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacanta.functions.patterns import LANGUAGES, Dictionary, Keyword
from vacanta.functions.text import list_key, normalize

# A keyword too ambiguous to match at all.
EXCLUDED_KEYWORDS = ("Copilot",)
# Acronyms matched by their spelled-out forms.
FORM_OVERRIDES = {
    "LLM": {
        "en": "Large language models",
        "de": "Große Sprachmodelle",
        "fr": "Grands modèles de langage",
        "it": "Modelli linguistici di grandi dimensioni",
    },
    "RAG": {
        "en": "Retrieval-Augmented Generation",
        "de": "Abrufgestützte Generierung",
        "fr": "Génération augmentée par récupération",
        "it": "Generazione aumentata dal recupero",
    },
}
# Keywords moved between layers by hand, and English-only candidates of layer 3b.
FORCE_3A = ("Large language model", "Microsoft Copilot", "GitHub Copilot")
FORCE_3B = ("LLM", "Foundation Model", "Cohere")
NEW_3B_CANDIDATES = (
    "Copilot", "T5", "Transformer", "Falcon", "Fine-Tuning",
    "Music Generation", "Image Generation", "Jasper",
)


def read_validated(spark: SparkSession, path: str) -> DataFrame:
    """keyword, group, source, dhs_rate, avg_ratio from a JSON document with a keyword array."""
    item = "keyword:string,group:int,source:string,dhs_rate:double,avg_ratio:double"
    doc = spark.read.schema(f"keywords array<struct<{item}>>").json(path, multiLine=True)
    return doc.select(F.inline("keywords"))


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """lang, layer, list_type, pos, form from the per-language translation lists."""
    lists = "struct<keywords:array<string>,proper_nouns:array<string>>"
    layers = f"struct<layer1:{lists},layer2:{lists},layer3:{lists}>"
    doc = spark.read.schema(f"translations map<string,{layers}>").json(path, multiLine=True)
    cells = [
        F.struct(
            F.lit(layer).alias("layer"),
            F.lit(kind).alias("list_type"),
            F.col("v")[f"layer{layer}"][kind].alias("forms"),
        )
        for layer in (1, 2, 3)
        for kind in ("keywords", "proper_nouns")
    ]
    return (
        doc.select(F.explode("translations").alias("lang", "v"))
        .select("lang", F.inline(F.array(*cells)))
        .select("lang", "layer", "list_type", F.posexplode("forms").alias("pos", "form"))
    )


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Finished dictionary: one row per keyword with its forms."""
    forms = ",".join(f"{lang}:string" for lang in LANGUAGES)
    item = f"keyword:string,group:int,source:string,validated:boolean,forms:struct<{forms}>"
    doc = spark.read.schema(f"keywords array<struct<{item}>>").json(path, multiLine=True)
    return doc.select(F.inline("keywords")).select("keyword", "group", "source", "validated", "forms.*")


def lookup_forms(keywords: DataFrame, translations: DataFrame) -> DataFrame:
    """Add one form column per language by the keyword's position in the English lists.

    The first list containing the keyword decides. A missing position or a keyword found nowhere
    falls back to the keyword itself; ``found`` tells which.
    """
    en = translations.where("lang = 'en'").withColumnRenamed("form", "keyword")
    # "keywords" lists come before "proper_nouns", as the names do.
    first = Window.partitionBy("keyword").orderBy("layer", "list_type", "pos")
    place = (
        en.join(keywords.select("keyword").distinct(), "keyword", "left_semi")
        .withColumn("_rn", F.row_number().over(first))
        .where("_rn = 1")
        .select("keyword", "layer", "list_type", "pos")
    )
    at = ["layer", "list_type", "pos"]
    forms = (
        translations.join(place, at)
        .groupBy("keyword")
        .agg(*[F.max(F.when(F.col("lang") == lang, F.col("form"))).alias(lang) for lang in LANGUAGES])
        .withColumn("found", F.lit(True))
    )
    out = keywords.join(forms, "keyword", "left")
    for lang in LANGUAGES:
        out = out.withColumn(lang, F.coalesce(lang, "keyword"))
    return out.withColumn("found", F.coalesce("found", F.lit(False)))


def build_master(
    validated: DataFrame,
    translations: DataFrame,
    excluded: tuple[str, ...] = EXCLUDED_KEYWORDS,
    overrides: Mapping[str, Mapping[str, str]] = FORM_OVERRIDES,
) -> DataFrame:
    """Validated keywords with their forms, without the excluded ones, overrides applied last."""
    kept = validated.where(~F.col("keyword").isin(*excluded)) if excluded else validated
    out = lookup_forms(kept, translations)
    for lang in LANGUAGES:
        form = F.col(lang)
        for keyword, forms in overrides.items():
            form = F.when(F.col("keyword") == keyword, forms[lang]).otherwise(form)
        out = out.withColumn(lang, form)
    return out.withColumn("validated", F.lit(True))


def expand_master(
    master: DataFrame, candidates: DataFrame, translations: DataFrame, skip: tuple[str, ...] = EXCLUDED_KEYWORDS
) -> DataFrame:
    """Add candidates (keyword, source, layer, pos) that are new by name and by normalised form.

    Layers come in order, the first candidate of a normalised form wins. A candidate turned away
    for its name does not block later ones of the same form, so names known to the master are
    removed before candidates compete. The layer becomes the group.
    """
    fresh = (
        (candidates.where(~F.col("keyword").isin(*skip)) if skip else candidates)
        .join(master.select("keyword"), "keyword", "left_anti")
        .withColumn("_norm", normalize(F.col("keyword")))
        .join(master.select(normalize(F.col("en")).alias("_norm")), "_norm", "left_anti")
    )
    first = Window.partitionBy("_norm").orderBy("layer", "pos")
    fresh = fresh.withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
    new = lookup_forms(
        fresh.select("keyword", F.col("layer").cast("int").alias("group"), "source"), translations
    ).withColumn("validated", F.lit(False))
    return master.unionByName(new, allowMissingColumns=True)


def dedup_layers(lists: DataFrame) -> DataFrame:
    """(keyword, layer, pos): one keyword per case- and hyphen-insensitive key, earliest layer wins."""
    first = Window.partitionBy(list_key(F.col("keyword"))).orderBy("layer", "pos")
    return lists.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def mark_proper_nouns(keywords: DataFrame, non_translatable: DataFrame) -> DataFrame:
    """Tell proper nouns (listed, case-insensitive) from keywords that get translated."""
    names = non_translatable.select(F.lower("name").alias("_name")).distinct()
    return (
        keywords.withColumn("_name", F.lower("keyword"))
        .join(names.withColumn("proper_noun", F.lit(True)), "_name", "left")
        .withColumn("proper_noun", F.coalesce("proper_noun", F.lit(False)))
        .drop("_name")
    )


def forms_long(master: DataFrame) -> DataFrame:
    """(keyword, lang, form) rows."""
    return master.unpivot(["keyword"], list(LANGUAGES), "lang", "form")


def layer_of(
    keyword: Column,
    source: Column,
    force_3a: tuple[str, ...] = FORCE_3A,
    force_3b: tuple[str, ...] = FORCE_3B,
    new_3b: tuple[str, ...] = NEW_3B_CANDIDATES,
) -> Column:
    """Layer of a keyword: hand-set ones first, then by source list. An unknown source is an error."""
    return (
        F.when(keyword.isin(*force_3a), "3a")
        .when(keyword.isin(*force_3b, *new_3b), "3b")
        .when(source.isin("St", "H&L"), "1+2")
        .when(source == "LLM", "3a")
        .otherwise(F.raise_error(F.concat(F.lit("no layer for source "), F.coalesce(source, F.lit("null")))).cast("string"))
    )


def dictionary_frame(spark: SparkSession, dictionary: Dictionary) -> DataFrame:
    """A dictionary as rows: keyword, group, source, validated, matched English text."""
    kws = dictionary.keywords
    return spark.createDataFrame(
        pa.table(
            {
                "keyword": pa.array([k.keyword for k in kws], pa.string()),
                "group": pa.array([k.group for k in kws], pa.int32()),
                "source": pa.array([k.source for k in kws], pa.string()),
                "validated": pa.array([k.validated for k in kws], pa.bool_()),
                "matched_text": pa.array([k.forms.get("en") for k in kws], pa.string()),
            }
        )
    )


def to_dictionary(master: DataFrame, **options) -> Dictionary:
    """Collect a finished master table, which is a list a user keeps, as a matcher parameter."""
    return Dictionary(
        tuple(
            Keyword(r.keyword, r.group, r.source, {lang: r[lang] for lang in LANGUAGES}, r.validated)
            for r in master.select("keyword", "group", "source", "validated", *LANGUAGES)
            .orderBy("group", "keyword")
            .toLocalIterator()
        ),
        **options,
    )
