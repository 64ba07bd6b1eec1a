"""Threshold calibration over match signatures.

Keyword statuses are a handful of rows per dictionary; they come in as a scalar subquery, so the
signature table is read once, without a join or a shuffle, and all grid cells are counted in the
same aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacanta.functions.numbers import round_even
from vacanta.operators.match import keywords
from vacanta.operators.trend import C_GRID, K_GRID, TrendConfig


def _sets(status: DataFrame, **flags: str) -> Column:
    """One struct with the keyword set of each flag column."""
    one_row = status.agg(
        F.struct(
            *[F.collect_set(F.when(F.col(c), F.col("keyword"))).alias(n) for n, c in flags.items()]
        ).alias("s")
    )
    return one_row.scalar()


def _among(found: Column, names: Column) -> Column:
    return F.size(F.array_intersect(found, names))


def with_status_counts(
    sigs: DataFrame, status: DataFrame, n_cs: int, excluded: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``n_g1`` and ``n_g2_<i>``: distinct group 1 and group 2 keywords per signature."""
    flags = {"g1": "is_g1", **{f"g2_{i}": f"g2_{i}" for i in range(n_cs)}}
    found = keywords()
    if excluded:
        found = F.array_except(found, F.array(*map(F.lit, excluded)))
    out = sigs.withColumn("kws", found).withColumn("_sets", _sets(status, **flags))
    counts = {f"n_{n}": _among(F.col("kws"), F.col("_sets")[n]) for n in flags}
    return out.withColumns(counts).drop("_sets")


def flagged(n_g2: str, k: int) -> Column:
    """A group 1 keyword or at least k group 2 keywords."""
    return (F.col("n_g1") >= 1) | (F.col(n_g2) >= k)


def _ads(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("n_ads"))), F.lit(0))


def grid_sweep(
    counted: DataFrame,
    status: DataFrame,
    cs: tuple[float, ...] = C_GRID,
    ks: tuple[int, ...] = K_GRID,
    config: TrendConfig = TrendConfig(),
) -> DataFrame:
    """Flagged ads of the validation year for every (c, k), as count and share of all its ads.

    ``counted`` comes from :func:`with_status_counts` and includes ads without any match.
    """
    cells = [(i, c, k) for i, c in enumerate(cs) for k in ks]
    flagged_ads = [
        F.expr(f"coalesce(sum(if(n_g1 >= 1 OR n_g2_{i} >= {k}, n_ads, 0)), 0) AS f_{i}_{k}")
        for i, _, k in cells
    ]
    sizes = [F.expr(f"count_if(g2_{i}) AS s_{i}") for i in range(len(cs))]
    sizes = status.agg(F.struct(F.expr("count_if(is_g1) AS s_g1"), *sizes).alias("s")).scalar()
    rows = ", ".join(
        f"struct({c}D AS c, {k} AS k, s.s_{i} AS n_g2_keywords, s.s_g1 AS n_g1_keywords, "
        f"f_{i}_{k} AS flagged_ads, total AS total_ads)"
        for i, c, k in cells
    )
    return (
        counted.where(F.col("year") == config.validation)
        .agg(F.expr("coalesce(sum(n_ads), 0) AS total"), *flagged_ads)
        .withColumn("s", sizes)
        .select(F.expr(f"inline(array({rows}))"))
        .withColumn("flagged_share_pct", F.expr("coalesce(try_divide(100D * flagged_ads, total_ads), 0D)"))
    )


def grid_matrix(sweep: DataFrame, ks: tuple[int, ...] = K_GRID) -> DataFrame:
    """The sweep as a c by k matrix of flagged shares."""
    return sweep.groupBy("c").pivot("k", list(ks)).agg(F.first("flagged_share_pct"))


def elbow_k(sweep: DataFrame, ks: tuple[int, ...] = K_GRID, ratio: float = 0.1) -> DataFrame:
    """Per c, the first k from the third on whose step is at most ``ratio`` of the first step.

    Without such a step (or with a flat first one) the last k; c with fewer than three k drops out.
    """
    points = F.array_sort(F.collect_list(F.struct("k", "flagged_share_pct")))
    share = lambda i: F.col("p")[i]["flagged_share_pct"]
    first = F.abs(share(1) - share(0))
    later = [
        F.when(
            (F.size("p") > i) & (first > 0) & (F.abs(share(i) - share(i - 1)) <= ratio * first),
            F.col("p")[i]["k"],
        )
        for i in range(2, len(ks))
    ]
    rows = sweep.groupBy("c").agg(points.alias("p")).where(F.size("p") >= 3)
    return rows.select("c", F.coalesce(*later, F.element_at("p", -1)["k"]).alias("elbow_k"))


def newly_flagged(counted: DataFrame, i: int, k: int, config: TrendConfig = TrendConfig()) -> DataFrame:
    """Validation-year ads at one (c, k): flagged by group 1 alone, in all, and newly."""
    now = counted.where(F.col("year") == config.validation)
    g1 = F.col("n_g1") >= 1
    f = flagged(f"n_g2_{i}", k)
    return now.agg(
        _ads(g1).alias("g1_alone_total"),
        _ads(f).alias("flagged_total"),
        _ads(f & ~g1).alias("newly_flagged"),
    )


def newly_flagged_drivers(
    counted: DataFrame, status: DataFrame, i: int, k: int, config: TrendConfig = TrendConfig()
) -> DataFrame:
    """Group 2 keywords of the newly flagged ads and their share; ``dominant`` at half or more."""
    new = counted.where(
        (F.col("year") == config.validation) & flagged(f"n_g2_{i}", k) & (F.col("n_g1") == 0)
    )
    g2 = status.where(F.col(f"g2_{i}")).select("keyword")
    drivers = (
        new.select("n_ads", F.explode("kws").alias("keyword"))
        .groupBy("keyword")
        .agg(F.sum("n_ads").alias("n_ads"))
        .join(g2, "keyword", "left_semi")
    )
    total = new.agg(F.sum("n_ads")).scalar()
    out = drivers.withColumn("share", F.col("n_ads") / total)
    top = drivers.agg(F.max("n_ads")).scalar()
    return out.withColumn("dominant", (F.col("share") >= 0.5) & (F.col("n_ads") == top))


def keyword_flagged_counts(
    counted: DataFrame, i: int, ks: tuple[int, ...], config: TrendConfig = TrendConfig()
) -> DataFrame:
    """Per keyword: validation-year ads it matched that ended up flagged, one column per k."""
    hits = counted.where(F.col("year") == config.validation).select(
        "n_g1", f"n_g2_{i}", "n_ads", F.explode("kws").alias("keyword")
    )
    return hits.groupBy("keyword").agg(*[_ads(flagged(f"n_g2_{i}", k)).alias(f"flagged_k{k}") for k in ks])


def layer_sweep(
    sigs: DataFrame,
    layers: DataFrame,
    g1_keywords: DataFrame,
    ks: tuple[int, ...] = K_GRID,
    config: TrendConfig = TrendConfig(),
) -> DataFrame:
    """Per k: validation-year ads with at least k keywords outside group 1, and how many of them
    have one from each layer (overlapping).

    ``layers``: keyword, layer; ``g1_keywords``: keyword.
    """
    counted = with_layers(sigs, layers, g1_keywords, config)
    names = {"1+2": "B_layer12", "3a": "C_layer3a", "3b": "D_layer3b"}
    cells = []
    for k in ks:
        enough = F.col("n_other") >= k
        cells.append(_ads(enough).alias(f"A_{k}"))
        cells += [_ads(enough & (F.size(F.col(n)) > 0)).alias(f"{n}_{k}") for n in names.values()]
    pct = lambda n: round_even(F.try_divide(100.0 * F.col(n), F.col("A_total")), 1)
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                F.col(f"A_{k}").alias("A_total"),
                *[F.col(f"{n}_{k}").alias(n) for n in names.values()],
            )
            for k in ks
        ]
    )
    return (
        counted.agg(*cells)
        .select(F.inline(rows))
        .withColumns({f"{n[0]}_pct_of_A": pct(n) for n in names.values()})
    )


def with_layers(
    sigs: DataFrame, layers: DataFrame, g1_keywords: DataFrame, config: TrendConfig = TrendConfig()
) -> DataFrame:
    """Validation-year signatures with their non-group-1 keywords split by layer."""
    g1 = g1_keywords.agg(F.collect_set("keyword")).scalar()
    sets = layers.agg(
        F.struct(
            *[
                F.collect_set(F.when(F.col("layer") == layer, F.col("keyword"))).alias(n)
                for layer, n in {"1+2": "B_layer12", "3a": "C_layer3a", "3b": "D_layer3b"}.items()
            ]
        )
    ).scalar()
    out = (
        sigs.where(F.col("year") == config.validation)
        .withColumn("others", F.array_except(keywords(), g1))
        .withColumn("_s", sets)
        .withColumn("n_other", F.size("others"))
    )
    names = ("B_layer12", "C_layer3a", "D_layer3b")
    return out.withColumns({n: F.array_intersect("others", F.col("_s")[n]) for n in names}).drop("_s")


def layer_drivers(layered: DataFrame, k: int, column: str = "D_layer3b") -> DataFrame:
    """Keywords of one layer among ads with at least k, with their share of the ads it touches."""
    touched = layered.where((F.col("n_other") >= k) & (F.size(column) > 0))
    total = touched.agg(F.sum("n_ads")).scalar()
    return (
        touched.select("n_ads", F.explode(column).alias("keyword"))
        .groupBy("keyword")
        .agg(F.sum("n_ads").alias("n_ads"))
        .withColumn("share", F.col("n_ads") / total)
    )


def keyword_report(
    breakeven: DataFrame, g1: DataFrame, flagged_counts: DataFrame, texts: DataFrame, max_c: float = max(C_GRID)
) -> DataFrame:
    """Keyword table in three blocks: recent signal by breakeven, group 1 by volume, no match.

    ``would_cut`` marks signal keywords that drop out somewhere inside the tested grid.
    """
    zero = F.lit(0)
    flag_cols = [c for c in flagged_counts.columns if c != "keyword"]
    block = F.when(F.col("is_g1"), 2).when(F.col("y_val_all_langs") > 0, 1).otherwise(3)
    out = (
        g1.join(breakeven, "keyword")
        .join(flagged_counts, "keyword", "left")
        .join(texts.select("keyword", "matched_text"), "keyword", "left")
        .withColumns({c: F.coalesce(c, zero) for c in flag_cols})
        .withColumn("block", block)
        .withColumn("matched_text", F.when(F.col("matched_text") != F.col("keyword"), F.col("matched_text")).otherwise(""))
        .withColumn("breakeven_c", F.when(~F.col("is_g1"), F.col("breakeven_c")))
        .withColumn("would_cut", (F.col("block") == 1) & (round_even(F.col("breakeven_c"), 2) <= max_c))
    )
    within = [
        F.when(F.col("block") == 1, round_even(F.col("breakeven_c"), 2)),
        F.when(F.col("block") < 3, -F.col("y_val_all_langs")),
        F.col("keyword"),
    ]
    position = F.row_number().over(Window.partitionBy("block").orderBy(*within))
    return out.withColumn("position", position).orderBy("block", "position")
