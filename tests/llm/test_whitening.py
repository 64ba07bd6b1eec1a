"""Whitening against exact fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from vacanta.llm.batches import table
from vacanta.llm.queries import QUERIES
from vacanta.llm.whitening import SHIFT, whiten


def brute(vectors):
    """n, deviations, covariance and centred rows from exact fractions."""
    x = [[math.floor(64 * float(c)) + SHIFT for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    y = [[Fraction(n * r[i] - s[i], n) for i in range(d)] for r in x]
    v = np.array([[float(sum(r[i] * r[j] for r in y) / n) for j in range(d)] for i in range(d)])
    return n, [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x], v, np.array([[float(c) for c in r] for r in y])


def check(rows, vectors, most=32):
    n, deviation, v, y = brute(list(vectors.values()))
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    k = len(e)
    got = {}
    for r in rows:
        assert r.n == n and abs(r.explained - e[r.component - 1] / np.trace(v)) <= 1e-9
        got.setdefault(r.id, {})[r.component] = r
    assert set(got) == set(vectors) and all(set(c) == set(range(1, k + 1)) for c in got.values())
    for place, i in enumerate(vectors):
        assert {int(r.deviation) for r in got[i].values()} == {deviation[place]}
    w = np.array([[got[i][c + 1].whitened for c in range(k)] for i in vectors])
    wanted = y @ u / np.sqrt(e)
    assert np.allclose(w * np.sign((w * wanted).sum(axis=0)), wanted, atol=1e-6)
    error = np.abs(w.T @ w / n - np.eye(k)).max()
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error <= 1e-4 and abs(rows[0].identity_error - error) < 1e-9


@pytest.mark.parametrize(("n", "d", "scale"), [(60, 5, 1.0), (200, 40, 0.3), (50, 3, 1e9), (40, 4, 1e13)])
def test_against_fractions(spark, n, d, scale):
    rng = np.random.default_rng(n)
    mixed = rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) * scale
    vectors = {i: v.tolist() for i, v in enumerate(mixed)}
    rows = whiten(spark.createDataFrame(list(vectors.items()), "id long, v array<double>").repartition(5), "id", "v").collect()
    check(rows, vectors)


def test_query_against_fractions(spark, sf_dir):
    rows = QUERIES["op11_whitening"](spark, sf_dir).withColumnRenamed("vec_id", "id").collect()
    check(rows, {r.vec_id: r.embedding for r in table(spark, sf_dir, "embeddings").collect()})


def test_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    good = {i: rng.standard_normal(3).tolist() for i in range(30)}
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, [])]
    other = [(200 + i, [float(i), 1.0]) for i in range(4)]
    frame = spark.createDataFrame([*good.items(), *bad, *other, (None, good[0])], "id long, v array<float>").selectExpr("*", "1 AS n", "2 AS whitened")
    rows = whiten(frame, "id", "v").collect()
    assert {r.id for r in rows} == {*good, None, *(i for i, _ in other)}
    assert {r.n for r in rows if r.id in good or r.id is None} == {31}
    # The second dimension of the pairs does not vary: no scale, no error.
    pairs = [r for r in rows if r.id is not None and r.id >= 200]
    assert {r.n for r in pairs} == {4} and all((r.whitened is None) == (r.component == 2) for r in pairs)
    assert all(r.identity_error < 1e-9 for r in pairs)


def test_equal_single_and_no_vectors(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "id long, v array<double>")
    rows = whiten(same, "id", "v").collect()
    assert len(rows) == 6 and {(r.whitened, r.explained, int(r.deviation), r.identity_error) for r in rows} == {(None, 0.0, 0, None)}
    assert whiten(same.limit(1), "id", "v").count() == 2
    assert whiten(same.limit(0), "id", "v").collect() == []
