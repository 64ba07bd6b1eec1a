import itertools
import re
from string import ascii_lowercase

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from test_text import plain
from vacanta.functions.patterns import (
    Dictionary,
    Keyword,
    plural_variants,
    prefilter_literals,
    prefix_tree_pattern,
)
from vacanta.operators.match import (
    _longest_first_pattern,
    candidates,
    classify_group,
    forms_table,
    match_by_join,
    match_keywords,
    match_longest_first,
    passes_prefilter,
)
from vacanta.operators.triple_lock import beside_makers
from vacanta.plans.views import TEST_DICTIONARY, ads
from vacanta.sources.staging import stage


def kw(name, group=1, **forms):
    return Keyword(name, group, "St", {lang: forms.get(lang, forms.get("en", name)) for lang in ("en", "de", "fr", "it")})


def found(spark, words, texts, matcher=match_keywords, language="en", **options):
    df = spark.createDataFrame([(i, t, language) for i, t in enumerate(texts)], "ad_id int, text string, language string")
    rows = matcher(df, words, **options).orderBy("ad_id").collect()
    return [{(m.bucket, m.keyword) for m in r.matches} for r in rows]


def test_english_plural_takes_s_on_last_word_only(spark):
    words = Dictionary((kw("foundation model"),))
    hits = found(spark, words, ["Foundation Models!", "foundations model", "foundation-model", "foundation modelss"])
    assert [bool(h) for h in hits] == [True, False, True, False]


def test_french_plural_agrees_but_not_after_preposition(spark):
    words = Dictionary((kw("x", en="zzz", fr="grand modele de langage"),))
    texts = ["Grands modèles de langage", "grand modele de langages", "grand modèles de langage"]
    assert [bool(h) for h in found(spark, words, texts, language="fr")] == [True, False, True]


def test_plural_variants():
    assert plural_variants("news", "en") == ["news"]
    assert plural_variants("ab cd", "en") == ["ab cd", "ab cds"]
    assert set(plural_variants("la voix rapide", "fr")) == {"la voix rapide", "la voix rapides"}
    assert plural_variants("ab cd", "de") == ["ab cd"]


def test_prefix_tree_prefers_longest():
    pattern = re.compile(prefix_tree_pattern(["ab", "abc", "abd e", "x"]))
    assert [m.group() for m in pattern.finditer("abc abd e ab x abd")] == ["abc", "abd e", "ab", "x", "ab"]


def test_law_degree_is_not_the_acronym(spark):
    assert found(spark, Dictionary((kw("LLM"),)), ["LL.M. Zürich", "an LLM", "LLMs"]) == [set(), {("en", "LLM")}, {("en", "LLM")}]


def test_independent_and_longest_first_differ_on_nested_forms(spark):
    words = Dictionary((kw("GPT"), kw("GPT-4")))
    text = ["we use GPT-4", "GPT and GPT 4", "GPT-4o"]
    assert found(spark, words, text) == [{("en", "GPT"), ("en", "GPT-4")}, {("en", "GPT"), ("en", "GPT-4")}, {("en", "GPT")}]
    assert found(spark, words, text, match_longest_first, prefilter=False) == [
        {("en", "GPT-4")}, {("en", "GPT"), ("en", "GPT-4")}, {("en", "GPT")},
    ]


def test_overlapping_phrases_all_count(spark):
    words = Dictionary((kw("a b c"), kw("b c d"), kw("c")))
    assert found(spark, words, ["x a b c d"]) == [{("en", "a b c"), ("en", "b c d"), ("en", "c")}]


def test_scope_is_english_plus_own_language(spark):
    words = Dictionary((kw("net", en="network", de="Netz", fr="réseau"),))
    text = ["Netz network", "réseaux"]
    assert found(spark, words, text, language="de") == [{("en", "net"), ("de", "net")}, set()]
    assert found(spark, words, text, language="fr") == [{("en", "net")}, set()]
    assert found(spark, words, text, language="rm") == [{("en", "net")}, set()]
    assert found(spark, words, text, language=None) == [{("en", "net")}, set()]


def test_counterpart_forms(spark):
    words = Dictionary((kw("Foundation Model", de="Basismodell", it="Modello di base"),))
    assert found(spark, words, ["Basismodelle"], language="de") == [{("de", "Foundation Model")}]
    assert found(spark, words, ["modelli di base"], language="it") == [{("it", "Foundation Model")}]


def test_extra_patterns_and_candidates(spark):
    words = Dictionary((kw("LLM", en="large language models"),), extra_patterns={"LLM": r"\bllms?\b"})
    assert found(spark, words, ["LLMs", "LL.M."]) == [{("en", "LLM")}, set()]
    more = words.extended(["Fine-Tuning"])
    assert found(spark, more, ["fine tuning", "fine tunings"]) == [{("en", "Fine-Tuning")}, set()]


def test_prefilter_drops_short_only_hits(spark):
    words = Dictionary((kw("GPT"), kw("chatbot")))
    text = ["only GPT here", "GPT beside a chatbot", "CHATBOTS and GPT"]
    hits = found(spark, words, text, match_longest_first)
    assert hits == [set(), {("en", "GPT"), ("en", "chatbot")}, {("en", "GPT")}]


def test_first_letters_count_in_either_case(spark):
    words = Dictionary((kw("Kit"), kw("\u00e9tude"), kw("3d"), kw("_x")))
    texts = ["KIT", "\u212ait", "\u00c9tude 3D", "_X", "ait kits"]
    hits = [{k for _, k in h} for h in found(spark, words, texts, match_longest_first, prefilter=False)]
    assert hits == [{"Kit"}, {"Kit"}, {"\u00e9tude", "3d"}, {"_x"}, set()]
    pattern = _longest_first_pattern(["kit", "\u017fan"])
    assert "(?-iu:[KSks[^\\x00-\\x7F]])" in pattern
    rows = spark.createDataFrame([(t,) for t in ("KIT", "\u212ait", "it", "_ \u017fan")], "t string").select(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("x")).collect()
    assert [r.x for r in rows] == [["KIT"], ["\u212ait"], [], ["\u017fan"]]


def test_prefilter_asks_the_passages_first(spark):
    """The whole text is searched only where no passage has a literal itself; both ways drop the same ads."""
    words = Dictionary((kw("GPT"), kw("chat bot"), kw("\u03bb\u03cc\u03b3\u03bf\u03c2")))
    texts = ["GPT, chatbot", "GPT, a chat  bot", "GPT, CHAT-BOT", "chat\tbot", "\u039b\u038c\u0393\u039f\u03a3", "\u039b\u038c\u0393\u039f\u03a3-GPT", "GPT xchat botx", None]
    expected = []
    for text, hits in zip(texts, found(spark, words, texts[:-1], match_longest_first, prefilter=False) + [set()], strict=True):
        row = spark.createDataFrame([(text,)], "text string").select(passes_prefilter(F.col("text"), words).alias("ok")).first()
        expected.append(hits if row.ok else set())
    assert found(spark, words, texts, match_longest_first) == expected and expected[2] == {("en", "GPT"), ("en", "chat bot")} and expected[0] == set()
    out = match_longest_first(spark.createDataFrame([("a", "en")], "text string, language string"), words)
    assert re.search(r"exists\(concat\(.*?RLIKE.*? OR ", out._jdf.queryExecution().analyzed().toString(), re.S | re.I)


def test_makers_are_sought_beside_copilot_only(spark):
    rows = [(1, "x", ["Copilot"]), (2, "github", ["Copilot"]), (3, "github", ["A"]), (4, None, ["Copilot"]), (5, "github", [])]
    df = spark.createDataFrame([(i, t, [("en", k, 1) for k in ks]) for i, t, ks in rows], "ad_id int, text string, matches array<struct<bucket:string,keyword:string,group:int>>")
    assert [r.m for r in df.select("ad_id", beside_makers().alias("m")).orderBy("ad_id").collect()] == [False, True, False, False, False]


def test_prefilter_literals_are_minimal():
    words = Dictionary((kw("data base"), kw("base"), kw("abc")))
    assert prefilter_literals(words) == ["base"]


def test_raw_text_edges(spark):
    words = Dictionary((kw("attion to"), kw("atan")))
    text = ["x\U00010400atan", "attion to", "éatan", "½atan", "_atan", "ÜATAN", "atań"]
    hits = found(spark, words, text, match_longest_first, prefilter=False)
    assert [bool(h) for h in hits] == [False, True, True, False, False, False, True]


def brute_force(words, text, language):
    norm = plain(text or "")
    out = set()
    for bucket in {"en", language} & {"en", "de", "fr", "it"}:
        for spelling, kws in words.variants(bucket).items():
            if f" {spelling} " in f" {norm} ":
                out |= {(bucket, k.keyword, k.group) for k in kws}
    return out


def by_join(ads, words, **options):
    return match_by_join(ads, forms_table(ads.sparkSession, words), **options)


@pytest.mark.parametrize("matcher", [match_keywords, by_join])
def test_one_pass_equals_search_per_keyword(spark, sf_dir, matcher):
    rows = matcher(ads(spark, sf_dir), TEST_DICTIONARY).collect()
    assert len(rows) == 200
    for r in rows:
        assert {tuple(m) for m in r.matches} == brute_force(TEST_DICTIONARY, r.text, r.language), r.ad_id
        assert len(set(r.matches)) == len(r.matches)


def test_join_handles_texts_shorter_than_a_phrase(spark):
    words = Dictionary((kw("a b c"), kw("a")))
    assert found(spark, words, ["a", "", None, "a b c"], by_join) == [
        {("en", "a")}, set(), set(), {("en", "a"), ("en", "a b c")},
    ]


def test_group_is_the_best_one_with_only_its_triggers(spark):
    words = Dictionary((kw("b", 2), kw("a", 2), kw("c", 3), kw("d", 1)))
    df = spark.createDataFrame([(1, "c b a", "en"), (2, "c", "en"), (3, "z", "en")], "ad_id int, text string, language string")
    rows = {r.ad_id: (r.group, r.matched_group_keywords) for r in classify_group(match_keywords(df, words)).collect()}
    assert rows == {1: ("2", ["a", "b"]), 2: ("3", ["c"]), 3: ("NA", [])}


def test_candidates_widen_by_raw_pattern(spark):
    df = spark.createDataFrame([("NA", "Falcon 9"), ("NA", "x"), ("1", "x")], "group string, text string")
    assert candidates(df).count() == 1
    assert candidates(df, "falcon").count() == 2


def test_text_is_scanned_once(spark, sf_dir):
    """Filters and several uses of the result must not repeat the match."""
    out = classify_group(match_keywords(ads(spark, sf_dir), TEST_DICTIONARY))
    out = out.where(F.col("group") != "NA").groupBy("group", "matched_group_keywords").count()
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    # Lists per language, each written once.
    assert plan.count("regexp_extract_all") == 4


def test_ten_thousand_spellings_classify_as_one_by_one(spark):
    """One matcher at any size: null and repeated ids keep their own hits, on either way."""
    names = [f"{a}{b}{'s' if i % 7 == 0 else ''} {c}" for i, (a, b, c) in enumerate(itertools.product(ascii_lowercase, ascii_lowercase, ("x", "ys", "s zz", "model", "models", "q", "r", "t")))]
    words = Dictionary(tuple(Keyword(n, 1 + i % 3, "St", {"en": n, "fr": f"{n} fr", "de": f"{n} de"}) for i, n in enumerate(names)))
    assert sum(len(words.variants(lang)) for lang in ("en", "fr", "de")) > 10_000
    rows = [
        (1, "aa x and ab model", "en"), (1, "nothing", "en"), (None, "zz models fr", "fr"), (None, "aas x", "fr"), (None, None, "en"), (2, "ca s zz ca s zzs", "de"),
        (3, "ab  models; ac-ys", "en"), (3, "ab  models; ac-ys", "en"), (4, "ss xs", "fr"),
    ]
    ads = spark.createDataFrame(rows, "ad_id int, text string, language string")
    from vacanta.plans.pipeline import classify
    from vacanta.schema import ColumnMap, PrepareConfig

    config = PrepareConfig(columns=ColumnMap(job_id="ad_id", content="text"))
    for out in (match_keywords(ads, words), by_join(ads, words), classify(ads.withColumn("detected_language", F.col("language")), words, config)):
        got = sorted((str(r.ad_id), r.text or "", sorted(map(str, r.matches))) for r in out.collect())
        expected = sorted((str(i), t or "", sorted(str(Row(bucket=b, keyword=k, group=g)) for b, k, g in brute_force(words, t, lang))) for i, t, lang in rows)
        assert got == expected


def test_short_forms_meet_the_sequences_without_a_shuffle(spark):
    rows = stage(spark.createDataFrame([(i, f"a b c {i}", "en") for i in range(50)], "ad_id int, text string, language string"), "ads")
    out = by_join(rows, Dictionary((kw("a b c"), kw("a"), kw("b 7"))))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(spelling" not in plan and "BroadcastHashJoin [spelling" in plan
    assert [len(r.matches) for r in out.orderBy("ad_id").collect()] == [2] * 50


def test_join_refuses_a_stream(spark):
    stream = spark.readStream.format("rate").load().selectExpr("'a' AS text", "'en' AS language")
    with pytest.raises(ValueError, match="stream"):
        match_by_join(stream, forms_table(spark, Dictionary((kw("a"),))))


def test_words_that_end_in_s_need_it(spark):
    words = Dictionary((kw("business"), kw("busines"), kw("s"), kw("gas law"), kw("ga laws x")))
    texts = ["business", "busines", "busine", "s", "ss", "gas law", "ga law", "gas laws", "ga laws x", "businesss"]
    for text, hits in zip(texts, found(spark, words, texts, match_keywords), strict=True):
        assert hits == {(b, k) for b, k, _ in brute_force(words, text, "en")}, text
