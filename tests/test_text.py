import re
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vacanta.functions.text import _fold_tables, list_key, normalize, normalize_py, preview

CASES = {
    "DevOps/MLOps": "devops mlops",
    "LL.M.": "ll m",
    "Domain's": "domains",
    "Domain’s": "domains",
    "Vector-Database": "vector database",
    "Vector  Database": "vector database",
    "Büro": "buero",
    "Straße": "strasse",
    "Génération": "generation",
    "Büro": "buro",
    "™": "",
    "ﬁn ½": "fin 1 2",
    "snake_case": "snake case",
    "ａｂ": "ab",
    "don＇t": "dont",
    "": "",
    None: "",
    "  –x– \n": "x",
}


def plain(text):
    """The rules stated with the standard library."""
    low = text.lower()
    for a, b in (("ü", "ue"), ("ö", "oe"), ("ä", "ae"), ("ß", "ss")):
        low = low.replace(a, b)
    base = [c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c)]
    joined = "".join(base).replace("'", "").replace("’", "")
    return " ".join(re.findall("[a-z0-9]+", joined))


def test_normalize_examples(spark):
    rows = spark.createDataFrame([(k, v) for k, v in CASES.items()], "t string, expected string")
    for r in rows.select("t", "expected", normalize(F.col("t")).alias("n")).collect():
        assert r.n == r.expected, r.t
        assert normalize_py(r.t) == r.expected, r.t


def test_normalize_agrees_with_unicode_rules(spark):
    deleted, single, multi = _fold_tables()
    points = {ord(c) for c in (*deleted, *single, *multi)} | set(range(0x80, 0x2400)) | {0x10400, 0x1F600}
    texts = pd.DataFrame({"t": [f"a{chr(p)}b {chr(p)} x{chr(p)}" for p in sorted(points)]})
    got = spark.createDataFrame(texts).repartition(8).select("t", normalize(F.col("t")).alias("n")).toPandas()
    wrong = [(t, n) for t, n in zip(got.t, got.n) if n != plain(t) or normalize_py(t) != n]
    assert not wrong


@pytest.mark.parametrize("text, expected", [("  a\nb ", "a b"), ("x" * 301, "x" * 300 + "..."), ("y" * 300, "y" * 300), (None, "")])
def test_preview(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(preview(F.col("t"))).first()[0] == expected


def test_list_key(spark):
    df = spark.createDataFrame([("Fine-Tuning",), ("fine tuning",)], "t string")
    assert df.select(list_key(F.col("t"))).distinct().count() == 1
