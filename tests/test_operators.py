import json

import pytest
from pyspark.sql import functions as F

from vacanta.operators import triple_lock as tl
from vacanta.operators.crosswalk import two_hop
from vacanta.operators.dedup import keep_first
from vacanta.operators.dictionary import build_master, expand_master, layer_of, read_translations, read_validated, to_dictionary
from vacanta.operators.prepare import (
    any_element,
    drop_secondary_tag,
    exclude_size,
    flatten_and_filter,
    parse_timestamp,
)
from vacanta.operators.regression import t_two_sided_p
from vacanta.operators.nest import Child, nest_children
from vacanta.operators.screening import outlier_firm_years, sample_per_group
from vacanta.operators.strategies import newly_flagged_drivers, corroborated
from vacanta.operators.trend import TrendConfig, keyword_breakeven, keyword_g1, keyword_status, keyword_trend, ols
from vacanta.schema import ad_schema, has_field


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_two_timestamp_formats(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05.678901 UTC",), ("2024-01-02 03:04:05.678901",)], "t string")
    assert df.select(parse_timestamp(F.col("t"))).distinct().count() == 1


def test_has_field():
    schema = ad_schema()
    assert has_field(schema, "company.size.employees.minimum")
    assert has_field(schema, "locations.country")
    assert not has_field(schema, "company.size.nothing")


def test_wide_filters(spark):
    place = [{"country": "CH", "province": None, "district": None, "postal_code": None}]

    def ad(key, recruiter=False, locations=place, size=1):
        company = {"id": 7, "name": "f", "is_recruiter": recruiter, "size": {"id": size, "name": "s"}, "metadata": None}
        return {"duplicate_group": key, "tst_created": "2024-01-02 00:00:00.0 UTC", "locations": locations, "company": company}

    made = [ad("keep"), ad("unknown", None), ad("agency", True), ad("nowhere", locations=None), ad("abroad", locations=[{**place[0], "country": "DE"}])]
    out = flatten_and_filter(spark.createDataFrame(made, ad_schema()))
    assert rows(out, "duplicate_group", "_firm_id", "_size_id", "_industry") == [("keep", 7, "1", None)]


def test_unknown_sizes_stay_unless_strict(spark):
    df = spark.createDataFrame([("1",), ("2",), (None,)], "_size_id string")
    assert exclude_size(df, "1").count() == 2
    assert exclude_size(df, "1", strict_nulls=True).count() == 1


def test_null_array_drops_the_row(spark):
    df = spark.createDataFrame([([("a",)],), (None,), ([],)], "xs array<struct<v:string>>")
    assert any_element(df, "xs", "v", "a").count() == 1


@pytest.mark.parametrize(
    "ids, strict, lax",
    [
        (["1"], ["1"], ["1"]),
        (["1", "2"], ["2"], ["2"]),
        (["2"], ["2"], ["2"]),
        ([], [], []),
        (["1", "1"], ["1", "1"], ["1", "1"]),
        (["1", "x", "2"], ["1", "x", "2"], ["x", "2"]),
        (["2", "x", "1"], ["2", "x"], ["2", "x"]),
        (["x", "1"], ["x", "1"], ["x", "1"]),
    ],
)
def test_secondary_tag(spark, ids, strict, lax):
    df = spark.createDataFrame([([(i,) for i in ids],)], "tags array<struct<id:string>>")
    got = df.select(drop_secondary_tag(F.col("tags"), 1)["id"], drop_secondary_tag(F.col("tags"), 1, False)["id"]).first()
    assert [list(got[0]), list(got[1])] == [strict, lax]


def test_dedup_keeps_null_keys_and_first(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 2), ("b", 9)], "k string, o int")
    assert sorted((str(r.k), r.o) for r in keep_first(df, "k", ["o"]).collect()) == [("None", 1), ("None", 2), ("a", 2), ("b", 9)]


def test_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    out = keep_first(df, "k", ["id"])
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert plan.count("WindowGroupLimit") == 2
    assert out.count() == 667


def test_outliers_need_a_spread(spark):
    busy = [(f, "s", 2020) for f in range(30) for _ in range(3)] + [(99, "s", 2020)] * 500
    lone = [(1, "one", 2020)] * 50
    missing = [(1, None, 2020)] * 5000
    df = spark.createDataFrame(busy + lone + missing, "firm_id int, size_id string, year int")
    assert rows(outlier_firm_years(df, {}), "firm_id", "size_id") == [(99, "s")]


def test_ols_and_benchmark(spark):
    years = list(range(2016, 2021))
    df = spark.createDataFrame([(0, 0, 1, 1, 0)], ", ".join(f"y{y} int" for y in years))
    fit = ols(years, 2025)
    got = df.select(*[fit[k].alias(k) for k in ("slope", "intercept", "yhat", "mean")]).first()
    assert [round(v, 9) for v in got] == [0.1, 0.2, 1.1, 0.4]
    one = ols([2016], 2025)
    assert tuple(df.select(one["slope"], one["intercept"]).first()) == (0.0, 0.0)


def counts(spark, data):
    return spark.createDataFrame(
        [(y, lang, k, n) for (k, lang), per in data.items() for y, n in per.items()],
        "year int, bucket string, keyword string, n long",
    )


def test_keyword_status(spark):
    names = spark.createDataFrame([("late",), ("grows",), ("flat",), ("gone",)], "keyword string")
    data = {
        ("late", "en"): {2023: 1},
        ("grows", "de"): {**{y: 2 for y in range(2016, 2021)}, 2025: 12},
        ("grows", "en"): {2018: 50},
        ("flat", "en"): {**{y: 9 for y in range(2016, 2021)}, 2025: 9},
    }
    trend = keyword_trend(names, counts(spark, data))
    assert {r.keyword: r.is_g1 for r in keyword_g1(trend).collect()} == {"late": True, "grows": False, "flat": False, "gone": False}
    status = {r.keyword: (r.g2_0, r.g2_1) for r in keyword_status(trend, (6.0, 6.1)).collect()}
    assert status == {"late": (False, False), "grows": (True, False), "flat": (False, False), "gone": (False, False)}
    # A benchmark of zero in a second language does not help below the floor.
    assert keyword_status(trend, (0.0,), TrendConfig(min_hits=9)).where("g2_0").count() == 2


def test_breakeven_prefers_first_language_and_knows_infinity(spark):
    trend = spark.createDataFrame(
        [("a", "de", 2.0, 4, 2.0), ("a", "en", 3.0, 6, 3.0), ("b", "fr", 0.0, 1, 0.0), ("b", "en", 1.0, 50, 1.0), ("c", "it", 0.0, 0, 0.0), ("c", "en", 0.0, 0, 0.0)],
        "keyword string, lang string, B double, y_val long, mean double",
    )
    got = {r.keyword: (r.best_lang, r.breakeven_c) for r in keyword_breakeven(trend).collect()}
    assert got == {"a": ("en", 2.0), "b": ("fr", float("inf")), "c": ("en", 0.0)}


def test_dominant_driver(spark):
    df = spark.createDataFrame(
        [(0, 2, 0, ["a", "b"], [], 3), (0, 1, 1, ["a"], ["c"], 2), (1, 1, 1, ["z"], ["z2"], 9)],
        "g1_count int, g2_count int, g3_count int, g2_kw array<string>, g3_kw array<string>, n_ads long",
    )
    out = newly_flagged_drivers(df, corroborated(2), "n_ads")
    assert rows(out, "keyword", "n_ads", "share", "dominant") == [("a", 5, 1.0, True), ("b", 3, 0.6, False), ("c", 2, 0.4, False)]


def test_expand_order(spark):
    """A candidate refused for its name must not block a later one with the same form."""
    master = spark.createDataFrame([("LLM", "Large language models")], "keyword string, en string")
    listed = [("LLM", "St", 1, 0), ("llm", "LLM", 3, 0), ("L.L.M", "LLM", 3, 1), ("Large-Language Models", "St", 1, 1), ("ll m", "St", 2, 0), ("Copilot", "St", 2, 1)]
    candidates = spark.createDataFrame(listed, "keyword string, source string, layer int, pos int")
    none = spark.createDataFrame([], "lang string, layer int, list_type string, pos int, form string")
    out = expand_master(master.withColumn("validated", F.lit(True)), candidates, none)
    assert rows(out, "keyword", "validated") == [("L.L.M", False), ("LLM", True), ("ll m", False), ("llm", False)]


def test_dictionary_from_files(spark, tmp_path):
    validated = {"keywords": [{"keyword": k, "group": g, "source": "St", "dhs_rate": 2.0, "avg_ratio": None} for k, g in (("Net", 1), ("Brand", 2), ("Copilot", 2), ("LLM", 3), ("Odd", 3))]}
    empty = {"keywords": [], "proper_nouns": []}
    lists = {"en": ["Net", "Other"], "de": ["Netz", "Anderes"], "fr": ["Réseau"], "it": ["Rete", "Altro"]}
    tr = {"translations": {la: {"layer1": empty, "layer2": {"keywords": kws, "proper_nouns": ["Brand"]}, "layer3": {"keywords": ["Net"], "proper_nouns": []}} for la, kws in lists.items()}}
    (tmp_path / "v.json").write_text(json.dumps(validated))
    (tmp_path / "t.json").write_text(json.dumps(tr))
    master = build_master(read_validated(spark, str(tmp_path / "v.json")), read_translations(spark, str(tmp_path / "t.json")))
    assert rows(master, "keyword", "de", "fr", "found") == [
        ("Brand", "Brand", "Brand", True),
        ("LLM", "Große Sprachmodelle", "Grands modèles de langage", False),
        ("Net", "Netz", "Réseau", True),
        ("Odd", "Odd", "Odd", False),
    ]
    assert [k.keyword for k in to_dictionary(master).keywords] == ["Net", "Brand", "LLM", "Odd"]


def test_layers(spark):
    df = spark.createDataFrame([("GitHub Copilot", "LLM"), ("LLM", "H&L"), ("T5", "new"), ("x", "St"), ("y", "LLM")], "k string, s string")
    assert [r[0] for r in df.select(layer_of(F.col("k"), F.col("s"))).collect()] == ["3a", "3b", "3b", "1+2", "3a"]
    with pytest.raises(Exception, match="no layer for source"):
        spark.createDataFrame([("z", "blog")], "k string, s string").select(layer_of(F.col("k"), F.col("s"))).collect()


def test_sample_cuts_repeated_keys_and_keeps_null_groups(spark):
    df = spark.createDataFrame([("a", 1, "x")] * 9 + [(None, k, "y") for k in range(7)], "g string, k int, t string")
    out = sample_per_group(df, "g", "k", 3)
    assert sorted((str(r.g), r.t) for r in out.collect()) == [("None", "y")] * 3 + [("a", "x")] * 3


def test_orphans_join_no_parent(spark):
    parent = spark.createDataFrame([(1,), (None,)], "id int")
    child = spark.createDataFrame([(1, "a"), (None, "b")], "p int, v string")
    out = nest_children(parent, "id", [Child(child, "p", F.col("v"), "vs")])
    assert sorted((str(r.id), r.vs) for r in out.collect()) == [("1", ["a"]), ("None", [])]


def test_two_hop_prefers_newest_catalogue(spark):
    first = spark.createDataFrame([(1, "n", 10, "2000"), (1, "n", 11, "2020"), (2, "m", 12, "2020"), (3, "o", 13, "2020")], "id int, name string, mid int, catalogue string")
    second = spark.createDataFrame([(10, 100), (11, 111), (11, 112), (12, 120)], "mid int, code int")
    titles = spark.createDataFrame([(111, "T")], "code int, title string")
    assert rows(two_hop(first, second, titles), "id", "code", "label") == [(1, 111, "T"), (2, 120, "m")]


def groups(spark, *pairs):
    return spark.createDataFrame([(k, lang, g, g) for k, lang, g in pairs], "keyword string, lang string, group int, en_group int")


def test_ad_rules(spark):
    match = "array<struct<bucket:string,keyword:string,group:int>>"
    made = [
        (1, [("en", "A", None)], "dev", False),
        (2, [("en", "B", None)], "dev", False),
        (3, [("en", "B", None)], "chef", False),
        (4, [("en", "B", None), ("en", "C", None), ("de", "D", None)], "chef", False),
        (5, [("en", "C", None), ("en", "E", None), ("de", "D", None)], "dev", False),
        (6, [("en", "Copilot", None)], "Pilot/in", False),
        (7, [("en", "Copilot", None)], "chef", True),
        (8, [("en", "F", None)], "dev", True),
        (9, [], "dev", True),
        (10, [("en", "A", None), ("de", "A", None)], None, None),
    ]
    df = spark.createDataFrame(made, f"ad_id int, matches {match}, occupation string, makers boolean")
    rated = groups(spark, ("A", "en", 1), ("A", "de", 2), ("B", "en", 2), ("C", "en", 3), ("F", "en", 4), ("Copilot", "en", 2))
    dense = spark.createDataFrame([("dev",), ("Pilot/in",)], "occupation string")
    out = {r.ad_id: r for r in tl.flag_rules(df, rated, dense).collect()}
    rules = {i: (r.flag_rule_1, r.flag_rule_2, r.flag_rule_3, r.flag_rule_copilot) for i, r in out.items()}
    assert rules == {
        1: (True, False, False, False),
        2: (False, True, False, False),
        3: (False, False, False, False),
        4: (False, False, True, False),
        5: (False, False, False, False),
        6: (False, False, False, False),
        7: (False, False, False, True),
        8: (False, False, False, False),
        9: (False, False, False, False),
        10: (True, False, False, False),
    }
    assert out[5].matched_g3_keywords == ["C", "D", "E"]
    assert out[10].matched_g2_keywords == ["A"] and out[10].matched_keywords == ["A"]
    lenient = tl.flag_rules(df, rated, dense, tl.RuleConfig(enforce_occupation=False))
    assert rows(lenient.where("flag_rule_2"), "ad_id") == [(2,), (3,), (4,), (7,), (10,)]


def test_copilot_context(spark):
    df = spark.createDataFrame([("a Microsoft tool",), ("schemas-microsoft-com",), ("GitHub",), ("microsofts",)], "t string")
    assert [r[0] for r in df.select(F.col("t").rlike(tl.COPILOT_CONTEXT)).collect()] == [True, False, True, False]


def test_intensive_occupations_stop_after_crossing(spark):
    df = spark.createDataFrame(
        [("a", 50, 100, 0.5), ("b", 25, 100, 0.25), ("c", 10, 100, 0.1), ("d", 10, 100, 0.1), ("e", 5, 500, 0.01)],
        "occupation string, g1_ads long, total_ads long, intensity double",
    )
    assert rows(tl.intensive_occupations(df), "occupation") == [("a",), ("b",), ("c",)]
    none = df.withColumn("g1_ads", F.lit(0)).withColumn("intensity", F.lit(0.0))
    assert tl.intensive_occupations(none).count() == 0
    assert rows(tl.intensive_occupations(none, tl.RuleConfig(min_intensity=0.0)), "occupation") == [("a",)]


def test_dhs_english_rule_and_weak_signal(spark):
    names = spark.createDataFrame([("new",), ("weak",), ("old",)], "keyword string")
    data = {
        ("new", "en"): {2025: 5},
        ("weak", "en"): {2025: 2},
        ("old", "en"): {**{y: 10 for y in range(2012, 2022)}, 2025: 10},
        ("old", "de"): {2025: 9},
    }
    rated = {(r.keyword, r.lang): (r.own_group, r.group) for r in tl.dhs_groups(names, counts(spark, data)).collect()}
    assert rated["new", "en"] == (1, 1) and rated["new", "fr"] == (4, 4)
    assert rated["weak", "en"] == (3, 3) and rated["weak", "de"] == (4, 3)
    assert rated["old", "en"] == (4, 4) and rated["old", "de"] == (1, 4)


def test_old_counts_format_is_refused(spark):
    df = spark.createDataFrame([(1,)], "format_version int")
    with pytest.raises(Exception, match="old format"):
        tl.check_counts_version(df).collect()


@pytest.mark.parametrize("t, df, p", [(2.228138852, 10, 0.05), (12.7062047, 1, 0.05), (0.0, 5, 1.0), (1.0, 1, 0.5)])
def test_student_p(spark, t, df, p):
    assert abs(spark.range(1).select(t_two_sided_p(F.lit(t), F.lit(df))).first()[0] - p) < 1e-6
