"""Keyword matching over a corpus.

All matchers add one column ``matches: array<struct<bucket, keyword, group>>``. ``bucket`` is the
language the hit counts under: "en" for an English form whatever the ad's language, else the ad's
own language.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacanta.functions.patterns import (
    LOCAL_LANGUAGES,
    Dictionary,
    longest_first_table,
    prefilter_literals,
    prefix_tree_pattern,
    stem_tree_pattern,
)
from vacanta.functions.text import fold, json_literal, normalize
from vacanta.sources.staging import stage

MATCH_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("bucket", T.StringType()),
            T.StructField("keyword", T.StringType()),
            T.StructField("group", T.IntegerType()),
        ]
    )
)
def _hit(bucket: str, keyword: str, group: int | None) -> Column:
    return F.struct(
        F.lit(bucket).alias("bucket"),
        F.lit(keyword).alias("keyword"),
        F.lit(group).cast("int").alias("group"),
    )


def _no_hits() -> Column:
    return F.array().cast(MATCH_TYPE)


#: Entries per map of a literal table: Spark searches a map from its start.
_PER_MAP = 8


def _table(entries: dict[str, list[dict]], value: str) -> Callable[[Column], Column]:
    """Look-up in a literal table: an array of small maps, chosen by a checksum of the key."""
    n = max(1, len(entries) // _PER_MAP)
    maps: list[dict[str, list[dict]]] = [{} for _ in range(n)]
    for key, found in entries.items():
        maps[zlib.crc32(key.encode()) % n][key] = found
    literal = json_literal(maps, f"array<map<string,array<{value}>>>")
    return lambda key: F.get(literal, (F.crc32(key) % n).cast("int"))[key]


def _distinct(hits: Column) -> Column:
    """Union of hit lists, sorted and without repeats."""
    return F.array_sort(F.array_distinct(F.flatten(hits)))


def _independent_hits(text: Column, dictionary: Dictionary, language: str | None) -> Column:
    """Hits of every keyword searched on its own in folded ``text``, in one pass.

    Forms are word sequences. Of two found at the same word the longer one starts with the shorter
    one, so it is enough to find the longest one at each word (a look-ahead, as matches may
    overlap) and add all forms it starts with. The pattern takes an optional "s" at every word;
    which of the forms allow the endings that were found is told by their bits.
    """
    scope = dictionary.scope(language)
    if not scope:
        return _no_hits()
    table = {}
    for stems in scope:
        words = stems.split(" ")
        found = {e for end in range(1, len(words) + 1) for e in scope.get(" ".join(words[:end]), ())}
        table[stems] = [asdict(e) for e in sorted(found, key=str)]
    entries = _table(table, "struct<bucket:string,keyword:string,group:int,fixed:int,ends:int>")
    # Any gap between words counts, so the text need not be rewritten word by word first.
    pattern = rf"(?<!\w)(?=({stem_tree_pattern(scope, gap=_WORD_GAP)})(?!\w))"
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))

    def hits(sequence: Column) -> Column:
        words = F.split(sequence, _WORD_GAP)
        has_s = lambda w: (F.length(w) > 1) & F.endswith(w, F.lit("s"))
        stems = F.array_join(F.transform(words, lambda w: F.when(has_s(w), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)), " ")
        ends = F.aggregate(
            F.transform(words, lambda w, i: F.when(has_s(w), F.call_function("shiftleft", F.lit(1), i)).otherwise(F.lit(0))),
            F.lit(0), lambda a, b: a + b,
        )
        # Endings and look-up once per sequence, not once per entry.
        one = F.array(F.struct(ends.alias("ends"), F.coalesce(entries(stems), F.array()).alias("entries")))
        accepted = F.transform(one, lambda x: F.filter(x["entries"], lambda e: x["ends"].bitwiseAND(e["fixed"]) == e["ends"]))
        return F.transform(F.flatten(accepted), lambda e: F.struct(e["bucket"].alias("bucket"), e["keyword"].alias("keyword"), e["group"].alias("group")))

    return _distinct(F.transform(found, hits))


_WORD_GAP = r"\W+"


def _extra_hits(text: Column, dictionary: Dictionary) -> Column:
    groups = {k.keyword: k.group for k in dictionary.keywords}
    tests = [
        F.when(text.rlike(p), _hit("en", name, groups.get(name)))
        for name, p in dictionary.extra_patterns.items()
    ]
    return F.array_compact(F.array(*tests))


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is evaluated once per row.

    The optimizer copies the definition of a projected column into every filter and projection
    above that uses it, which would repeat the text scan for each use. It does not look through a
    generator, and one over a single-element array adds no rows.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def match_keywords(
    ads: DataFrame,
    dictionary: Dictionary,
    text: str = "text",
    language: str = "language",
    normalized: bool = False,
) -> DataFrame:
    """Match each keyword independently on word boundaries of the normalised text.

    Scope per ad: the English forms plus the forms of its own language. The folded text is
    computed once per ad and dropped again. The way is the same for a dictionary of any size.
    """
    if not normalized:
        # Extra patterns are written for normalised text, the keyword patterns need less.
        prepared = normalize if dictionary.extra_patterns else fold
        ads = with_once(ads, "_norm", prepared(F.col(text)))
    norm = F.col(text if normalized else "_norm")
    per_language = None
    for lang in LOCAL_LANGUAGES:
        hits = _independent_hits(norm, dictionary, lang)
        cond = F.col(language) == lang
        per_language = F.when(cond, hits) if per_language is None else per_language.when(cond, hits)
    hits = per_language.otherwise(_independent_hits(norm, dictionary, None))
    if dictionary.extra_patterns:
        hits = F.array_sort(F.array_distinct(F.concat(hits, _extra_hits(norm, dictionary))))
    return with_once(ads, "matches", hits).drop("_norm")


def forms_table(spark: SparkSession, dictionary: Dictionary) -> DataFrame:
    """All spellings of a dictionary as a table for :func:`match_by_join`."""
    rows = [
        (spelling, bucket, kw.keyword, kw.group)
        for bucket in ("en", *LOCAL_LANGUAGES)
        for spelling, kws in dictionary.variants(bucket).items()
        for kw in kws
    ]
    return spark.createDataFrame(rows, "spelling string, bucket string, keyword string, group int")


def match_by_join(
    ads: DataFrame,
    forms: DataFrame,
    text: str = "text",
    language: str = "language",
    normalized: bool = False,
) -> DataFrame:
    """Result of :func:`match_keywords` for a table of forms that is data itself, of any size.

    ``forms``: spelling (normalised), bucket, keyword, group. Word sequences up to the longest
    spelling are joined with it. Forms are staged first, so that the join knows their true size: forms
    that are short enough to send around meet the sequences where these are made, and for others the
    sequences of a text are made distinct before they are shuffled. Only hits are grouped back. Hits
    depend on text and language alone, so they are grouped and joined by a digest of the two: ids may be
    missing or repeated. Batch only.
    """
    if ads.isStreaming:
        raise ValueError("match_by_join groups over the whole table and does not run on a stream; use match_keywords")
    forms = stage(forms.select("spelling", "bucket", "keyword", "group"), "forms")
    longest = forms.agg(F.max(F.size(F.split("spelling", " ")))).first()[0] or 1
    norm = F.col(text) if normalized else normalize(F.col(text))
    digest = F.unhex(F.sha2(F.concat_ws("\0", F.coalesce(F.col(language), F.lit("")), F.coalesce(F.col(text), F.lit(""))), 256))

    def sequences_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice("_words", i, n), " "))

    sequences = F.array_distinct(F.flatten(F.array(*[sequences_of(n) for n in range(1, longest + 1)])))
    found = (
        ads.select(digest.alias("_key"), F.col(language).alias("_lang"), F.split(norm, " ").alias("_words"))
        .select("_key", "_lang", F.explode(sequences).alias("spelling"))
        .join(forms, "spelling")
        .where((F.col("bucket") == "en") | (F.col("bucket") == F.col("_lang")))
        .groupBy("_key")
        .agg(F.array_sort(F.collect_set(F.struct("bucket", "keyword", "group"))).alias("_hits"))
    )
    out = ads.withColumn("_key", digest).join(found, "_key", "left")
    return out.withColumn("matches", F.coalesce(F.col("_hits"), _no_hits())).drop("_hits", "_key")


# Word edges where letters, digits and "_" of any script count as word characters and combining
# marks do not. The last member is a letter beyond the BMP: it adds nothing to the class but makes
# the look-behinds step over whole surrogate pairs.
_WORD = "[\\p{L}\\p{N}_\U00010400]"
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_GAP = r"[\s\x1C-\x1F\x85\p{Z}\-]+"


def _longest_first_pattern(spellings: Iterable[str]) -> str:
    """Any spelling between word edges.

    The start edge is tried before the tree, and on most characters the plain ASCII test settles it. Of
    ASCII characters only those that a spelling begins with, in either case, come to the costly part of it.
    """
    words = [s for s in spellings if s[0] == "_" or s[0].isalnum()]
    others = [s for s in spellings if s not in set(words)]
    cased = {c for s in words for x in (s[0], *s[0].lower(), *s[0].upper()) for c in (x, *x.lower(), *x.upper())}
    first = rf"(?=(?-iu:[{''.join(sorted(c for c in cased if c.isascii()))}[^\x00-\x7F]]))"
    starts = [(rf"(?<!\w){first}(?<!{_WORD})", words), (rf"(?<={_WORD})", others)]
    branches = [e + f"(?:{prefix_tree_pattern(part, gap=_GAP)})" for e, part in starts if part]
    return f"(?iu)(?:{'|'.join(branches)}){_EDGE}"


def _longest_first_found(text: Column, dictionary: Dictionary, language: str) -> Column:
    """Distinct passages of ``text`` that are spellings of a language, as they are written."""
    table = longest_first_table(dictionary, language)
    if not table:
        return F.array().cast("array<string>")
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_longest_first_pattern(table)), F.lit(0)))


def _longest_first_hits(found: Column, dictionary: Dictionary, language: str) -> Column:
    table = longest_first_table(dictionary, language)
    if not table:
        return _no_hits()
    groups = {k.keyword: k.group for k in dictionary.keywords}
    spelling = F.array_distinct(
        F.transform(found, lambda s: F.lower(F.regexp_replace(s, _GAP, " ")))
    )
    entries = {s: [{"bucket": language, "keyword": k, "group": groups[k]}] for s, k in table.items()}
    return _distinct(F.transform(spelling, _table(entries, MATCH_TYPE.elementType.simpleString())))


def passes_prefilter(text: Column, dictionary: Dictionary, min_length: int = 4) -> Column:
    """Whether the lower-cased text contains any dictionary literal of ``min_length`` or more."""
    literals = prefilter_literals(dictionary, min_length)
    if not literals:
        return F.lit(False)
    return F.coalesce(F.lower(text).rlike(prefix_tree_pattern(literals)), F.lit(False))


def match_longest_first(
    ads: DataFrame,
    dictionary: Dictionary,
    text: str = "text",
    language: str = "language",
    prefilter: bool = True,
) -> DataFrame:
    """Match on the raw text, case-insensitive, spaces and hyphens interchangeable.

    Matches do not overlap and the longest form wins at a position, so a hit of a long form hides
    a shorter one inside it. With ``prefilter`` an ad without any literal of four or more
    characters has no hits, even if a shorter keyword occurs.
    """
    def of_language(hits: Callable[[str], Column], none: Column) -> Column:
        local = None
        for lang in LOCAL_LANGUAGES:
            cond = F.col(language) == lang
            local = F.when(cond, hits(lang)) if local is None else local.when(cond, hits(lang))
        return local.otherwise(none)

    def found(lang: str) -> Column:
        return _longest_first_found(F.col(text), dictionary, lang)

    passages = F.struct(found("en").alias("en"), of_language(found, F.array().cast("array<string>")).alias("local"))
    out = with_once(ads, "_found", passages)
    english = _longest_first_hits(F.col("_found.en"), dictionary, "en")
    hits = F.array_sort(F.concat(english, of_language(lambda lang: _longest_first_hits(F.col("_found.local"), dictionary, lang), _no_hits())))
    if not prefilter:
        return with_once(out, "matches", hits).drop("_found")
    # The literal test looks at every character, so it is left to the few ads of whose passages none
    # has a literal itself. Lower case of a sigma depends on what follows, which a passage does not show.
    sure = [x for x in prefilter_literals(dictionary) if not set(x) & set("\u03c3\u03c2")]
    passes = passes_prefilter(F.col(text), dictionary)
    if sure:
        own = F.exists(F.concat("_found.en", "_found.local"), lambda s: F.lower(s).rlike(prefix_tree_pattern(sure)))
        passes = own | passes
    out = with_once(out, "_hits", hits)
    passed = F.when(F.size("_hits") > 0, F.when(passes, F.col("_hits")))
    return with_once(out, "matches", F.coalesce(passed, _no_hits())).drop("_hits", "_found")


def keywords(matches: Column | None = None) -> Column:
    """Distinct keywords of a ``matches`` column, sorted."""
    matches = F.col("matches") if matches is None else matches
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["keyword"])))


def keywords_of_group(group: int, matches: Column | None = None) -> Column:
    matches = F.col("matches") if matches is None else matches
    return keywords(F.filter(matches, lambda m: m["group"] == group))


def classify_group(matched: DataFrame) -> DataFrame:
    """Best (lowest) group of all matches as a string, "NA" without any, and its keywords."""
    best = F.array_min(F.transform("matches", lambda m: m["group"]))
    out = with_once(matched, "_best", best)
    triggers = keywords(F.filter("matches", lambda m: m["group"] == F.col("_best")))
    return out.withColumns(
        {
            "group": F.coalesce(F.col("_best").cast("string"), F.lit("NA")),
            "matched_group_keywords": triggers,
        }
    ).drop("_best")


def simple_score(matched: DataFrame) -> DataFrame:
    """Any match flags the ad; the score is the number of distinct keywords."""
    found = keywords()
    flag = F.size(found) > 0
    no = F.lit(False)
    return matched.withColumns(
        {
            "matched_keywords": found,
            "genai_score": F.size(found),
            "genai_flag": flag,
            "flag_rule_1": flag,
            "flag_rule_2": no,
            "flag_rule_3": no,
            "flag_rule_copilot": no,
            "group1_match": flag,
            "group2_match": no,
        }
    )


def candidates(classified: DataFrame, extra_regex: str | None = None, text: str = "text") -> DataFrame:
    """Ads that can carry a match: already grouped, or hit by an additional pattern."""
    cond = F.col("group") != "NA"
    if extra_regex:
        cond = cond | F.lower(text).rlike(extra_regex)
    return classified.where(cond)


def signatures(matched: DataFrame, *dims: str) -> DataFrame:
    """Collapse ads to distinct (dims, matches) with the number of ads behind each.

    Nearly all ads share the empty match set and partial aggregation removes them before the
    shuffle, so every keyword statistic downstream works on a small table instead of the corpus.
    """
    return matched.groupBy(*dims, "matches").agg(F.count(F.lit(1)).alias("n_ads"))
