"""Ways to combine keyword groups into an ad flag, compared.

Every sweep is one conditional aggregation: all thresholds are counted in the same pass and
unpivoted afterwards, nothing is multiplied by the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacanta.operators.match import keywords_of_group

# Score weights of groups 1 to 3 and the thresholds of the sweeps.
WEIGHTS = (3, 2, 1)
CORROBORATION_KS = (2, 3, 4, 5, 6)
SCORE_CUTOFFS = (3, 4, 5, 6)


def strategy_counts(classified: DataFrame) -> DataFrame:
    """Distinct keyword counts and lists per group for grouped ads.

    ``disagrees`` marks ads whose stored group has no keyword among the matches; a sound input has
    none.
    """
    out = classified.where(F.col("group") != "NA")
    for g in (1, 2, 3):
        out = out.withColumn(f"g{g}_kw", keywords_of_group(g))
        out = out.withColumn(f"g{g}_count", F.size(f"g{g}_kw"))
    own = (
        F.when(F.col("group") == "1", F.col("g1_count"))
        .when(F.col("group") == "2", F.col("g2_count"))
        .otherwise(F.col("g3_count"))
    )
    return out.withColumn("disagrees", own == 0)


def high_confidence() -> Column:
    return F.col("g1_count") >= 1


def corroborated(k: int) -> Column:
    return high_confidence() | (F.col("g2_count") + F.col("g3_count") >= k)


def score() -> Column:
    w1, w2, w3 = WEIGHTS
    return w1 * F.col("g1_count") + w2 * F.col("g2_count") + w3 * F.col("g3_count")


def _count(cond: Column, weight: str | None) -> Column:
    if weight is None:
        return F.count_if(cond)
    return F.coalesce(F.sum(F.when(cond, F.col(weight))), F.lit(0))


def option_a(counts: DataFrame, weight: str | None = None) -> DataFrame:
    """Two confidence tiers."""
    possible = F.col("g2_count") + F.col("g3_count") >= 1
    return counts.agg(
        _count(F.lit(True), weight).alias("population"),
        _count(high_confidence(), weight).alias("high_confidence"),
        _count(possible, weight).alias("possible_raw"),
        _count(possible & ~high_confidence(), weight).alias("possible_only"),
        _count(possible & high_confidence(), weight).alias("overlap"),
    )


def sweep(counts: DataFrame, name: str, conditions: dict[int, Column], weight: str | None = None) -> DataFrame:
    """Flagged ads per threshold and those flagged beyond the high-confidence ones."""
    aggs = []
    for cond in conditions.values():
        aggs += [_count(cond, weight), _count(cond & ~high_confidence(), weight)]
    wide = counts.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)])
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias(name),
                F.col(f"a{2 * i}").alias("total_flagged"),
                F.col(f"a{2 * i + 1}").alias("newly_flagged"),
            )
            for i, t in enumerate(conditions)
        ]
    )
    return wide.select(F.inline(rows))


def option_b(counts: DataFrame, ks: tuple[int, ...] = CORROBORATION_KS, weight: str | None = None) -> DataFrame:
    """A group 1 keyword, or at least k keywords of groups 2 and 3."""
    return sweep(counts, "k", {k: corroborated(k) for k in ks}, weight)


def option_c(counts: DataFrame, cutoffs: tuple[int, ...] = SCORE_CUTOFFS, weight: str | None = None) -> DataFrame:
    """Weighted score at or above a cutoff."""
    return sweep(counts, "cutoff", {c: score() >= c for c in cutoffs}, weight)


def overlap(counts: DataFrame, k: int = 2, cutoff: int = 4, weight: str | None = None) -> DataFrame:
    """Agreement of high confidence (A), corroboration (B) and score (C)."""
    a, b, c = high_confidence(), corroborated(k), score() >= cutoff
    return counts.agg(
        _count(a & ~b & ~c, weight).alias("a_only"),
        _count(~a & b & ~c, weight).alias("b_only"),
        _count(~a & ~b & c, weight).alias("c_only"),
        _count(a | b | c, weight).alias("any_flag"),
        _count(a & b & c, weight).alias("all_flags"),
        _count(b == c, weight).alias("b_c_agree"),
        _count(F.lit(True), weight).alias("population"),
    )


def newly_flagged_drivers(
    counts: DataFrame, flag: Column, weight: str | None = None, warn_above: float = 0.5, warn_at: bool = False
) -> DataFrame:
    """Keywords of groups 2 and 3 in ads flagged beyond group 1, with their share of those ads.

    ``dominant`` warns that one keyword alone carries the flag: only the most frequent one, if its
    share is above ``warn_above`` (or equal, with ``warn_at``).
    """
    new = counts.where(flag & ~high_confidence())
    n = F.col(weight) if weight else F.lit(1)
    exploded = new.select(n.alias("_n"), F.explode(F.concat("g2_kw", "g3_kw")).alias("keyword"))
    drivers = exploded.groupBy("keyword").agg(F.sum("_n").alias("n_ads"))
    total = new.agg(F.sum(n).alias("_total"))
    out = drivers.withColumn("share", F.col("n_ads") / total.select("_total").scalar())
    top = drivers.agg(F.max("n_ads").alias("_top")).select("_top").scalar()
    above = F.col("share") >= warn_above if warn_at else F.col("share") > warn_above
    return out.withColumn("dominant", above & (F.col("n_ads") == top))
