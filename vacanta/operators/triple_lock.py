"""Earlier scoring generation: disruption score, keyword groups per language, ad rules.

Works on signatures of :func:`operators.match.match_longest_first` and, for the ad rules, on the
matched ads themselves.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacanta.functions.patterns import Dictionary
from vacanta.operators.match import keywords, with_once
from vacanta.operators.running import running_total
from vacanta.operators.trend import ols, yearly_columns
from vacanta.sources.incremental import DIGESTS, partition_digests, read_partitioned
from vacanta.sources.io import write_by
from vacanta.sources.staging import stage

# Languages a keyword is rated in.
RATED_LANGUAGES = ("en", "de", "fr", "it", "rm", "sq", "es", "pt")
# Occupations in which "copilot" is no software term.
AVIATION_OCCUPATIONS = ("Pilot/in", "Kopilot/in", "Co-Pilot/in")
# Text that must accompany a bare "Copilot".
COPILOT_CONTEXT = r"(?i)(?<!schemas-)\bmicrosoft\b|\bgithub\b"


def copilot_context(first: str, second: str) -> str:
    """`COPILOT_CONTEXT` for other makers."""
    return COPILOT_CONTEXT.replace("microsoft", first).replace("github", second)


def beside_makers(text: str = "text", makers: str = COPILOT_CONTEXT) -> Column:
    """Whether an ad with "Copilot" among its ``matches`` names the makers; no other text is searched."""
    named = F.exists("matches", lambda m: m["keyword"] == "Copilot")
    return F.when(named, F.coalesce(F.col(text).rlike(makers), F.lit(False))).otherwise(F.lit(False))


# Format of stored keyword counts; older files are refused.
COUNTS_FORMAT_VERSION = 3
_COUNTS = "year int, month int, bucket string, keyword string, n long, month_total long, language_total long, format_version int"


@dataclass(frozen=True)
class RuleConfig:
    pre_start: int = 2012
    pre_end: int = 2021
    baseline_end: int = 2018
    validation: int = 2025
    cooccurrence_start: int = 2023
    dhs_g1: float = 1.95
    dhs_g2: float = 1.72
    dhs_g3: float = 1.0
    ratio_g2: float = 11.8
    ratio_g3: float = 20.0
    min_hits: int = 3
    min_g1: int = 1
    min_g2: int = 1
    min_g2g3: int = 3
    enforce_occupation: bool = True
    min_intensity: float = 0.02
    coverage: float = 0.8


def monthly_counts(ads: DataFrame) -> DataFrame:
    """Counts (year, month, bucket, keyword) with the totals of the month and of its language.

    ``ads``: year, month, language, text, matches. Ads without text or date count nowhere.
    """
    sound = ads.dropna(subset=["text", "year"])
    per_set = sound.groupBy("year", "month", "language", "matches").agg(
        F.count(F.lit(1)).alias("n_ads")
    )
    per_set = stage(per_set, "monthly-signatures")
    return counts_from_signatures(per_set)


def counts_from_signatures(sigs: DataFrame) -> DataFrame:
    """(year, month, bucket, keyword, n, month_total, language_total) plus the format version."""
    hits = (
        sigs.select("year", "month", "n_ads", F.explode("matches").alias("m"))
        .groupBy("year", "month", F.col("m.bucket").alias("bucket"), F.col("m.keyword").alias("keyword"))
        .agg(F.sum("n_ads").alias("n"))
    )
    totals = (
        sigs.groupBy("year", "month", F.col("language").alias("bucket"))
        .agg(F.sum("n_ads").alias("language_total"))
        .withColumn(
            "month_total", F.sum("language_total").over(Window.partitionBy("year", "month"))
        )
    )
    by_month = totals.groupBy("year", "month").agg(F.max("month_total").alias("month_total"))
    by_lang = totals.select("year", "month", "bucket", "language_total")
    return (
        hits.join(by_month, ["year", "month"], "left")
        .join(by_lang, ["year", "month", "bucket"], "left")
        .fillna(0, ["language_total"])
        .withColumn("format_version", F.lit(COUNTS_FORMAT_VERSION))
    )


def check_counts_version(counts: DataFrame) -> DataFrame:
    """Refuse stored counts of an older format.

    The test is a filter, so it stands whichever columns are read.
    """
    ok = F.coalesce(F.col("format_version") >= COUNTS_FORMAT_VERSION, F.lit(False))
    return counts.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("stored keyword counts have an old format")).cast("boolean")))


def dictionary_digest(dictionary: Dictionary) -> str:
    """Name of a dictionary's content."""
    return hashlib.sha256(repr(dictionary).encode()).hexdigest()


def reusable_counts(ads: DataFrame, path: str, dictionary: str = "") -> DataFrame:
    """Monthly counts kept at ``path`` and brought up to date: only months that have changed are counted.

    ``ads`` is as in :func:`monthly_counts`. Beside the counts lie a digest of each month's rows and the
    digest of the dictionary that they were matched with (:func:`dictionary_digest`). A month is counted
    again if its rows or the dictionary differ from what was counted, and its counts replace the old
    ones. Months that the corpus does not have (any more) are not returned. Digests are written last, so
    a run that was cut off counts again. Counts of an older format are all replaced.
    """
    spark = ads.sparkSession
    dated = ads.withColumn("period", (F.col("year") * 100 + F.coalesce("month", F.lit(0))).cast("int"))
    counted = dated.select("period", "year", "month", "language", "matches", F.col("text").isNull().alias("no_text"))
    digests = partition_digests(counted, "period").withColumns({"dictionary": F.lit(dictionary), "format_version": F.lit(COUNTS_FORMAT_VERSION)})
    digests = stage(digests, "month-digests")
    kept = read_partitioned(spark, f"{path}/{DIGESTS}", *digests.drop("period").schema.fields, digests.schema["period"])
    current = kept is not None and (kept.agg(F.min("format_version")).first()[0] or 0) >= COUNTS_FORMAT_VERSION
    stale = digests
    if current:
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("period", "n_source", "total", "parity", "dictionary")]
        was = kept.select([F.col(c).alias(f"_{c}") for c in ("period", "n_source", "total", "parity", "dictionary")])
        stale = digests.join(stage(was, "kept-digests"), reduce(Column.__and__, same), "left_anti")
    stale = stage(stale, "stale-months")
    if not current or not stale.isEmpty():
        redone = dated.join(stale.select(F.col("period").alias("_p")), F.col("period").eqNullSafe(F.col("_p")), "left_semi")
        counts = monthly_counts(redone).withColumn("period", (F.col("year") * 100 + F.coalesce("month", F.lit(0))).cast("int"))
        counts = stage(counts, "keyword-counts")
        # A month without a hit has a row of its own, which takes the place of what it had before.
        silent = stale.select("period").join(counts.select(F.col("period").alias("_p")), F.col("period").eqNullSafe(F.col("_p")), "left_anti")
        silent = silent.select([(F.col(f.name) if f.name == "period" else F.lit(COUNTS_FORMAT_VERSION) if f.name == "format_version" else F.lit(None).cast(f.dataType)).alias(f.name) for f in counts.schema.fields])
        written = counts.unionByName(silent)
        if current:
            write_by(written, path, "period")
        else:
            written.write.mode("overwrite").partitionBy("period").parquet(path)
        write_by(stale.coalesce(1), f"{path}/{DIGESTS}", "period")
    found = spark.read.schema(f"{_COUNTS}, period int").parquet(path)
    periods = digests.select(F.col("period").alias("_p"))
    return check_counts_version(found.join(periods, F.col("period").eqNullSafe(F.col("_p")), "left_semi").where("keyword IS NOT NULL").drop("period"))


def dhs_groups(all_keywords: DataFrame, counts: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """Rate every (keyword, lang): disruption score, ratio to the early baseline, group 1 to 4.

    ``counts``: year, bucket, keyword, n. ``own_group`` is the rating of the pair itself;
    ``group`` applies the English rule: an English 4 makes all languages 4, an English 3 caps all
    at 3.
    """
    pre = list(range(config.pre_start, config.pre_end + 1))
    years = sorted({*pre, *range(config.pre_end + 1, config.validation + 1)})
    yearly = counts.groupBy("year", "bucket", "keyword").agg(F.sum("n").alias("n"))
    dense = yearly_columns(all_keywords, yearly, years, RATED_LANGUAGES)
    fit = ols(pre, config.validation)
    base_years = [y for y in pre if y <= config.baseline_end]
    y_val = F.col(f"y{config.validation}").cast("double")
    base = sum((F.col(f"y{y}") for y in base_years[1:]), F.col(f"y{base_years[0]}")) / len(base_years)
    rated = dense.select(
        "keyword",
        "lang",
        base.alias("baseline"),
        fit["slope"].alias("slope"),
        fit["intercept"].alias("intercept"),
        fit["yhat"].alias("y_pred"),
        fit["se"].alias("se_res"),
        y_val.alias("y_actual"),
    )
    denominator = F.col("y_actual") + F.greatest(F.col("y_pred"), F.lit(0.0))
    rated = rated.withColumns(
        {
            "ratio": F.coalesce(F.try_divide("y_actual", "baseline"), F.lit(0.0)),
            "dhs": F.when(
                denominator > 0, 2.0 * (F.col("y_actual") - F.col("y_pred")) / denominator
            ).otherwise(0.0),
            "hits_all": F.sum("y_actual").over(Window.partitionBy("keyword")),
        }
    )
    zero = F.col("baseline") == 0
    group = (
        F.when(zero & (F.col("dhs") >= config.dhs_g1), 1)
        .when((F.col("dhs") >= config.dhs_g2) & (zero | (F.col("ratio") > config.ratio_g2)), 2)
        .when((F.col("dhs") >= config.dhs_g3) & (zero | (F.col("ratio") > config.ratio_g3)), 3)
        .otherwise(4)
    )
    weak = group.isin(1, 2) & (F.col("hits_all") < config.min_hits)
    rated = rated.withColumn("own_group", F.when(weak, 3).otherwise(group))
    english = F.max(F.when(F.col("lang") == "en", F.col("own_group"))).over(Window.partitionBy("keyword"))
    return rated.withColumn("en_group", english).withColumn(
        "group", F.when(F.col("en_group").isin(3, 4), F.col("en_group")).otherwise(F.col("own_group"))
    )


def _keywords_by_group(groups: DataFrame) -> Column:
    """Struct of the keyword sets of overall (English) groups 1 to 3, as a scalar subquery."""
    return groups.where("lang = 'en'").agg(
        F.struct(
            *[F.collect_set(F.when(F.col("group") == g, F.col("keyword"))).alias(f"g{g}") for g in (1, 2, 3)]
        ).alias("s")
    ).scalar()


def cooccurrence_rates(
    sigs: DataFrame, groups: DataFrame, all_keywords: DataFrame, config: RuleConfig = RuleConfig()
) -> DataFrame:
    """How often a keyword's ads also hold another keyword of group 1, 2, 3 and of 2 or 3.

    Recent years only; the other keyword must differ from the one rated. No ads: rates of 0.
    """
    recent = (
        sigs.where(F.col("year") >= config.cooccurrence_start)
        .select("n_ads", keywords().alias("kws"))
        .withColumn("_g", _keywords_by_group(groups))
    )
    sizes = {f"n{g}": F.size(F.array_intersect("kws", F.col("_g")[f"g{g}"])) for g in (1, 2, 3)}
    exploded = recent.withColumns(sizes).select(
        "n_ads", "n1", "n2", "n3", "_g", F.explode("kws").alias("keyword")
    )

    def other(g: int) -> Column:
        own = F.array_contains(F.col("_g")[f"g{g}"], F.col("keyword"))
        return ((F.col(f"n{g}") > 0) & ~own) | (F.col(f"n{g}") > 1)

    def ads(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n_ads")).otherwise(0))

    counted = exploded.groupBy("keyword").agg(
        F.sum("n_ads").alias("total"),
        ads(other(1)).alias("c1"),
        ads(other(2)).alias("c2"),
        ads(other(3)).alias("c3"),
        ads(other(2) | other(3)).alias("c23"),
    )
    names = {"c1": "g1_rate", "c2": "g2_rate", "c3": "g3_rate", "c23": "g2_g3_rate"}
    return all_keywords.select("keyword").join(counted, "keyword", "left").select(
        "keyword",
        F.coalesce("total", F.lit(0)).alias("total"),
        *[F.coalesce(F.try_divide(c, "total"), F.lit(0.0)).alias(n) for c, n in names.items()],
    )


def occupation_intensity(
    sigs: DataFrame, groups: DataFrame, config: RuleConfig = RuleConfig()
) -> DataFrame:
    """Group 1 ads over all ads of the validation year per first occupation."""
    now = sigs.where((F.col("year") == config.validation) & (F.col("occupation") != "")).withColumn(
        "_g", _keywords_by_group(groups)
    )
    has_g1 = F.size(F.array_intersect(keywords(), F.col("_g")["g1"])) > 0
    return (
        now.groupBy("occupation")
        .agg(
            F.sum("n_ads").alias("total_ads"),
            F.sum(F.when(has_g1, F.col("n_ads")).otherwise(0)).alias("g1_ads"),
        )
        .withColumn("intensity", F.col("g1_ads") / F.col("total_ads"))
    )


def intensive_occupations(intensity: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """Occupations by falling intensity until they cover enough group 1 ads, above a floor.

    The one that crosses the target is included; equal intensities go by name. Occupations are
    first summed per intensity, and the sum that runs over all intensities is taken in ranges of them
    side by side; ranks within an intensity are independent of each other.
    """
    total = intensity.agg(F.sum("g1_ads")).scalar()
    above = intensity.where(F.col("intensity") >= config.min_intensity)
    per_level = above.groupBy("intensity").agg(F.sum("g1_ads").alias("level_ads"))
    levels = running_total(per_level, F.col("intensity").desc(), "level_ads", "running").withColumn("before", F.col("running") - F.col("level_ads"))
    within = Window.partitionBy("intensity").orderBy("occupation")
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        above.join(levels.select("intensity", "before"), "intensity")
        .withColumn("covered", F.col("before") + F.sum("g1_ads").over(running))
        .withColumn("first", (F.col("before") == 0) & (F.row_number().over(within) == 1))
        .withColumn("total_g1_ads", total)
    )
    uncovered = F.col("covered") - F.col("g1_ads") < F.col("total_g1_ads") * config.coverage
    return ranked.where(uncovered | ((F.col("total_g1_ads") == 0) & F.col("first"))).select(
        "occupation",
        "g1_ads",
        "total_ads",
        "intensity",
        F.try_divide("covered", "total_g1_ads").alias("cumulative_coverage"),
    )


def flag_rules(
    matched: DataFrame,
    groups: DataFrame,
    intensive: DataFrame,
    config: RuleConfig = RuleConfig(),
    makers: str = "makers",
    occupation: str = "occupation",
) -> DataFrame:
    """Apply the ad rules to ads with ``matches``; ads without a match keep all defaults.

    Rule 1: enough group 1 keywords. Rule 2: enough group 2 keywords and, unless switched off, an
    intensive occupation; "copilot" does not count in aviation. Rule 3: enough keywords of groups
    2 and 3 with one of group 2. Copilot rule: "Copilot" beside its makers. A pair without a
    rating counts as group 3. The rated pairs and the occupations come in as scalar subqueries.

    ``makers`` is a boolean column: whether the text names them (`COPILOT_CONTEXT`). It is taken
    while matching, so the text itself need not be carried along.
    """
    pair = F.concat_ws("\u0001", "lang", "keyword")
    sets = groups.agg(
        F.struct(
            *[F.collect_set(F.when(F.col("group") == g, pair)).alias(f"g{g}") for g in (1, 2)],
            F.collect_set(F.when(F.col("group").isin(1, 2, 4), pair)).alias("rated"),
        ).alias("s")
    ).scalar()
    dense = intensive.agg(F.collect_set("occupation")).scalar()
    out = matched.withColumn("_s", sets).withColumn("_dense", dense)

    def of_group(g: int) -> Column:
        def key(m: Column) -> Column:
            return F.concat_ws("\u0001", m["bucket"], m["keyword"])

        def member(m: Column) -> Column:
            if g < 3:
                return F.array_contains(F.col("_s")[f"g{g}"], key(m))
            return ~F.array_contains(F.col("_s")["rated"], key(m))

        return keywords(F.filter("matches", member))

    # The lists are used by several rules and taken once per row.
    lists = {"matched_keywords": keywords(), **{f"matched_g{g}_keywords": of_group(g) for g in (1, 2, 3)}}
    out = with_once(out, "_lists", F.struct(*[x.alias(name) for name, x in lists.items()]))
    out = out.withColumns({name: F.col("_lists")[name] for name in lists}).drop("_lists")
    n1, n2, n3 = (F.size(f"matched_g{g}_keywords") for g in (1, 2, 3))
    aviation = F.coalesce(F.col(occupation).isin(*AVIATION_OCCUPATIONS), F.lit(False))
    not_copilot = F.filter("matched_g2_keywords", lambda k: F.lower(k) != "copilot")
    n2_rule2 = F.when(aviation, F.size(not_copilot)).otherwise(n2)
    in_dense = F.coalesce(F.array_contains("_dense", F.col(occupation)), F.lit(False))
    rule2 = n2_rule2 >= config.min_g2
    if config.enforce_occupation:
        rule2 = rule2 & in_dense
    has_match = F.size("matches") > 0
    copilot = F.array_contains("matched_keywords", "Copilot") & F.coalesce(makers, F.lit(False))
    out = out.withColumns(
        {
            "flag_rule_1": has_match & (n1 >= config.min_g1),
            "flag_rule_2": has_match & rule2,
            "flag_rule_3": has_match & (n2 + n3 >= config.min_g2g3) & (n2 >= 1),
            "flag_rule_copilot": copilot,
            "group1_match": n1 > 0,
            "group2_match": n2 > 0,
            "g1_count": n1,
            "g2_count": n2,
            "partner_count": n2,
        }
    ).drop("_s", "_dense")
    any_rule = (
        F.col("flag_rule_1") | F.col("flag_rule_2") | F.col("flag_rule_3") | F.col("flag_rule_copilot")
    )
    return out.withColumn("genai_flag", any_rule)


def keyword_group_map(groups: DataFrame, rates: DataFrame) -> DataFrame:
    """Overall group, group per language and co-occurrence rates per keyword."""
    per_lang = groups.groupBy("keyword").agg(
        F.max("en_group").alias("group"),
        *[F.max(F.when(F.col("lang") == lang, F.col("group"))).alias(f"group_{lang}") for lang in RATED_LANGUAGES],
    )
    rate_cols = ["g1_rate", "g2_rate", "g3_rate", "g2_g3_rate"]
    return per_lang.join(rates.select("keyword", *rate_cols), "keyword", "left").fillna(0.0, rate_cols)
