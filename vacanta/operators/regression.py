"""Regression of a share on an exposure, and extremes of a share."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacanta.sources.staging import stage


#: Terms of the continued fraction at most; it ends after about the square root of the degrees of freedom.
TERMS = 2000


def log_gamma(z: Column) -> Column:
    """Natural logarithm of the gamma function for z > 0: Stirling's series behind a shift by 8."""
    shift = 8
    x = z + shift
    # B(2k) / (2k (2k - 1)) of Stirling's series.
    terms = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360]
    series = reduce(lambda total, k: total + terms[k] / F.pow(x, F.lit(2 * k + 1)), range(len(terms)), F.lit(0.0))
    below = reduce(lambda total, k: total + F.log(z + k), range(shift), F.lit(0.0))
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series - below


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b), by Steed's evaluation of its continued fraction.

    One fold over the numbers of terms, which keeps its state once a term changes nothing any more.
    """
    swap = x > (a + 1) / (a + b + 2)
    given = F.struct(F.when(swap, 1 - x).otherwise(x).alias("x"), F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"))
    first = 1 / (1 - (given["a"] + given["b"]) * given["x"] / (given["a"] + 1))
    start = F.struct(F.lit(1.0).alias("num"), first.alias("den"), first.alias("fraction"), F.lit(False).alias("done"))

    def step(state: Column, m: Column) -> Column:
        p, q, u = given["a"], given["b"], given["x"]
        even = m * (q - m) * u / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * u / ((p + 2 * m) * (p + 2 * m + 1))
        num, den = 1 + even / state["num"], 1 / (1 + even * state["den"])
        num2, den2 = 1 + odd / num, 1 / (1 + odd * den)
        moved = F.struct(num2.alias("num"), den2.alias("den"), (state["fraction"] * num * den * num2 * den2).alias("fraction"), (F.abs(num2 * den2 - 1) < 1e-15).alias("done"))
        return F.when(state["done"], state).otherwise(moved)

    terms = F.sequence(F.lit(1), F.lit(TERMS))
    fraction = F.aggregate(F.transform(terms, lambda m: m.cast("double")), start, step)["fraction"]
    front = F.exp(log_gamma(given["a"] + given["b"]) - log_gamma(given["a"]) - log_gamma(given["b"]) + given["a"] * F.log(given["x"]) + given["b"] * F.log1p(-given["x"]))
    tail = F.when(given["x"] <= 0, 0.0).otherwise(front * fraction / given["a"])
    return F.when(swap, 1 - tail).otherwise(tail)


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t with ``df`` degrees of freedom; null where there are none."""
    t, df = t.cast("double"), df.cast("double")
    return F.when(df > 0, incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5)))


def share_exposure_ols(cells: DataFrame, share: str, exposure: str) -> DataFrame:
    """Slope, standard error, p-value, R squared and N of a linear fit over cells."""
    finite = cells.where(F.col(exposure).isNotNull() & ~F.isnan(exposure) & (F.abs(exposure) < float("inf")))
    fit = finite.agg(
        F.regr_slope(share, exposure).alias("slope"),
        F.regr_intercept(share, exposure).alias("intercept"),
        F.regr_r2(share, exposure).alias("r2"),
        F.regr_sxx(share, exposure).alias("sxx"),
        F.regr_syy(share, exposure).alias("syy"),
        F.regr_sxy(share, exposure).alias("sxy"),
        F.regr_count(share, exposure).alias("n"),
    )
    error = (F.col("syy") - F.col("slope") * F.col("sxy")) / (F.col("n") - 2)
    out = fit.withColumn("se", F.when(F.col("n") > 2, F.sqrt(F.greatest(error, F.lit(0.0)) / F.col("sxx"))))
    return out.withColumn(
        "p_value", t_two_sided_p(F.try_divide(F.abs("slope"), "se"), F.col("n").cast("double") - 2)
    ).select("slope", "intercept", "se", "p_value", "r2", "n")


def top_bottom(cells: DataFrame, share: str, key: str, n: int = 10) -> DataFrame:
    """The n highest and n lowest cells by share, labelled by panel. The cells are made once and staged."""
    cells = stage(cells, "cells")
    top = cells.orderBy(F.col(share).desc(), key).limit(n).withColumn("panel", F.lit(f"Top {n}"))
    low = cells.orderBy(F.col(share), key).limit(n).withColumn("panel", F.lit(f"Bottom {n}"))
    return top.unionByName(low)
