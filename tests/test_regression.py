"""The p-value of Student's t in column expressions."""

import math

from pyspark.sql import functions as F

from vacanta.operators.regression import log_gamma, share_exposure_ols, t_two_sided_p


def by_integral(t, df, n=200_000):
    """Simpson's rule over the density from 0 to t."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    density = lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2)
    h = abs(t) / n
    inner = 4 * sum(density((2 * i + 1) * h) for i in range(n // 2)) + 2 * sum(density(2 * i * h) for i in range(1, n // 2))
    return 1 - 2 * h / 3 * (density(0) + inner + density(abs(t)))


def test_p_values_equal_the_integral_of_the_density(spark):
    cases = [(t, df) for t in (0.0, 0.1, 1.0, 2.5, 6.0) for df in (1, 2, 3, 10, 37, 1000)]
    out = spark.createDataFrame([(float(t), float(d)) for t, d in cases], "t double, d double").select("t", "d", t_two_sided_p(F.col("t"), F.col("d")).alias("p"))
    for r in out.collect():
        assert abs(r.p - by_integral(r.t, r.d)) < 1e-10, r


def test_known_and_missing_p_values(spark):
    # Closed forms: one and two degrees of freedom; far tails keep their relative accuracy.
    rows = [(3.0, 1.0), (3.0, 2.0), (40.0, 2.0), (1e6, 1.0), (None, 3.0), (1.0, None), (1.0, 0.0), (1.0, -1.0), (1.5, 1e7), (-2.0, 5.0), (2.0, 5.0)]
    got = [r.p for r in spark.createDataFrame(rows, "t double, d double").coalesce(1).select(t_two_sided_p(F.col("t"), F.col("d")).alias("p")).collect()]
    two = lambda t: 1 - t / math.sqrt(2 + t * t)
    assert abs(got[0] - (1 - 2 * math.atan(3) / math.pi)) < 1e-12 and abs(got[1] - two(3)) < 1e-12
    assert abs(got[2] / (2 / (40 * 40 + 2 + 40 * math.sqrt(40 * 40 + 2))) - 1) < 1e-9 and abs(got[3] / (2 / (math.pi * 1e6)) - 1) < 1e-9
    assert got[4:8] == [None] * 4 and abs(got[8] - math.erfc(1.5 / math.sqrt(2))) < 1e-7 and got[9] == got[10]


def test_log_gamma(spark):
    values = [0.5, 1.0, 1.5, 2.0, 7.3, 50.0, 1e5]
    got = [r.g for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(log_gamma(F.col("v")).alias("g")).collect()]
    assert all(abs(g - math.lgamma(v)) <= 1e-13 * max(1, abs(math.lgamma(v))) + 1e-13 for g, v in zip(got, values, strict=True))


def test_the_fit_runs_without_python(spark):
    cells = spark.createDataFrame([(float(i), 2.0 * i + (i % 3)) for i in range(30)], "x double, y double")
    out = share_exposure_ols(cells, "y", "x")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert 0 <= out.first().p_value < 1e-20
    assert share_exposure_ols(cells.limit(2), "y", "x").first().p_value is None
