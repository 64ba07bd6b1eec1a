"""Whitened embeddings from a polarised covariance.

An entry c becomes the whole number x = floor(``SCALE`` * c) + ``SHIFT``. Covariances come from variances
only: cov(i, j) = (var(i + j) - var(i) - var(j)) / 2. One pass sums every dimension; the second sums the
squares of every dimension and of every sum of two dimensions, centred by the whole number next to the
mean before they are squared. What that number lacks to the mean is taken out in whole numbers too, so
variances, and with them all cross-covariances, are exact ratios of integers until they become a matrix
for ``eigh``. Sums leave a task as 32-bit limbs, one row per dimension pair, and are added up by Spark:
no number is rounded or overflows at any count of rows.

The model (means, 32 components, eigenvalues) and the sums of pairs are all that reaches the driver.
They grow with the square of the dimension and not with the rows. Rows are never shuffled.

Defined results: a vector that is null or holds null or non-finite entries gives no rows, and neither does
one without entries; the others give one row per component, repeated rows and rows with a null id
included. Vectors of different lengths are whitened apart, each length with a fit list of its own, as they
have no common covariance. A component without variance (eigenvalue up to ``FLAT`` of the trace) has a
null ``whitened`` and does not count in ``identity_error``, which is null where no component has any. An
entry whose x needs more than 60 bits is held at the nearest that does not. ``deviation`` is null where it
has more than 38 digits. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Share of the trace up to which an eigenvalue counts as zero.
FLAT = 1e-13
#: Limbs of 32 bits of a sum of squares: a squared pair sum has 124 bits, and 2**62 rows may be added.
LIMBS = 7
#: Entries of a batch that are squared at once.
BLOCK = 1 << 19
_LIMIT = 1 << 60


@dataclass
class Model:
    """Fit of all vectors of one length."""

    n: int
    #: Exact sums of x per dimension, and the whole numbers next to their means.
    sums: list[int]
    centre: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def scale(self) -> np.ndarray:
        """Factor of each component's projection, 0 for a component without variance."""
        full = self.eigenvalues > FLAT * self.trace
        return np.where(full, 1 / np.sqrt(np.where(full, self.eigenvalues, 1.0)), 0.0)


def whole_numbers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) of the usable vectors of a batch, by length, in blocks of rows."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(column).cast(pa.float64())
    usable = pc.fill_null(pc.is_finite(values), False).to_numpy(zero_copy_only=False)
    values = values.to_numpy(zero_copy_only=False)
    start = np.cumsum(lengths) - lengths
    bad = np.concatenate([[0], np.cumsum(~usable)])
    good = (lengths > 0) & (bad[start + lengths] == bad[start])
    for d in np.unique(lengths[good]):
        rows = np.flatnonzero(good & (lengths == d))
        step = max(1, BLOCK // int(d))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            c = values[start[some][:, None] + np.arange(d)]
            yield some, np.clip(np.floor(c * SCALE) + SHIFT, -float(_LIMIT), float(_LIMIT)).astype(np.int64)


def exact_sum(x: np.ndarray) -> list[int]:
    """Column sums as Python integers."""
    if np.abs(x).max(initial=0) < (1 << 62) // max(len(x), 1):
        return x.sum(axis=0).tolist()
    return x.astype(object).sum(axis=0).tolist()


def pair_squares(z: np.ndarray) -> Iterator[list[int]]:
    """Per dimension i: sums of z_i**2, then of (z_i + z_j)**2 for every j > i, all exact."""
    most = 2 * int(np.abs(z).max(initial=0))
    if most * most * max(len(z), 1) >= 1 << 63:
        z = z.astype(object)
    z = np.ascontiguousarray(z.T)
    for i in range(len(z)):
        rest = z[i:] + z[i]
        rest[0] = z[i]
        yield (rest * rest).sum(axis=1).tolist()


def limbs(values: list[int], count: int) -> list[pa.Array]:
    """``values`` as columns of 32 bits each, lowest first; the last is signed."""
    out = []
    for k in range(count):
        part = [v >> (32 * k) for v in values]
        out.append(pa.array(part if k == count - 1 else [p & 0xFFFFFFFF for p in part], pa.int64()))
    return out


def _summed(vectors: DataFrame, totals: Callable[[int, np.ndarray], list[int]], count: int) -> dict[int, tuple[int, dict[int, int]]]:
    """Per vector length the number of rows and the sums at each place, over all tasks."""
    names = [f"l{k}" for k in range(count)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for rows, x in whole_numbers(batch.column(0)):
                d, own = x.shape[1], totals(x.shape[1], x)
                n, before = held.get(d, (0, [0] * len(own)))
                held[d] = n + len(rows), [a + b for a, b in zip(before, own, strict=True)]
        for d, (n, sums) in held.items():
            place = pa.array(np.arange(-1, len(sums)), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(place), pa.int32()), place, *limbs([n, *sums], count)], ["d", "place", *names])

    parts = vectors.mapInArrow(run, "d int, place long, " + ", ".join(f"{n} long" for n in names))
    found: dict[int, dict[int, int]] = {}
    for row in parts.groupBy("d", "place").agg(*[F.sum(F.col(n).cast("decimal(38,0)")).alias(n) for n in names]).toArrow().to_pylist():
        found.setdefault(row["d"], {})[row["place"]] = sum(int(row[n]) << (32 * k) for k, n in enumerate(names))
    return {d: (sums.pop(-1), sums) for d, sums in found.items()}


def covariance(n: int, sums: list[int], squares: dict[int, int], centre: list[int]) -> np.ndarray:
    """Covariance matrix by polarisation of the variances of dimensions and of their pair sums."""
    d = len(sums)
    left = [s - n * c for s, c in zip(sums, centre, strict=True)]
    spread, out = [0] * d, np.zeros((d, d))
    place = 0
    crossed = []
    for i in range(d):
        for j in range(i, d):
            # n**2 times the variance: what is left of the sum is taken out in whole numbers.
            total = left[i] if i == j else left[i] + left[j]
            scaled = n * squares[place] - total * total
            place += 1
            if i == j:
                spread[i] = scaled
            else:
                crossed.append((i, j, scaled))
    for i in range(d):
        out[i, i] = spread[i] / (n * n)
    for i, j, both in crossed:
        out[i, j] = out[j, i] = (both - spread[i] - spread[j]) / (2 * n * n)
    return out


def fit(vectors: DataFrame) -> dict[int, Model]:
    """A model per vector length, from all usable vectors of the only column."""
    first = _summed(vectors, lambda d, x: exact_sum(x), 4)
    counted = {d: (n, [sums[i] for i in range(d)]) for d, (n, sums) in first.items()}
    centres = {d: [(2 * s + n) // (2 * n) for s in sums] for d, (n, sums) in counted.items()}
    if not counted:
        return {}

    def squares(d: int, x: np.ndarray) -> list[int]:
        return [v for row in pair_squares(x - np.array(centres[d], np.int64)) for v in row]

    models = {}
    for d, (n, found) in _summed(vectors, squares, LIMBS).items():
        sums = counted[d][1]
        v = covariance(n, sums, found, centres[d])
        e, u = np.linalg.eigh(v)
        order = np.argsort(-e, kind="stable")[:COMPONENTS]
        u = u[:, order]
        # One sign for all rows: the largest entry is positive.
        u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
        models[d] = Model(n, sums, np.array(centres[d], np.int64), u, np.maximum(e[order], 0.0), float(np.trace(v)))
    return models


def project(model: Model, x: np.ndarray) -> np.ndarray:
    """Whitened values of x, a column per component."""
    rest = np.array([(s - model.n * int(c)) / model.n for s, c in zip(model.sums, model.centre, strict=True)])
    return ((x - model.centre) - rest) @ model.components * model.scale


def deviations(model: Model, x: np.ndarray) -> pa.Array:
    """Sums of (n * x - S)**2, exact."""
    z = x - model.centre
    rest = [model.n * int(c) - s for s, c in zip(model.sums, model.centre, strict=True)]
    most = model.n * int(np.abs(z).max(initial=0)) + max(abs(r) for r in rest)
    if most * most * len(rest) < 1 << 63:
        y = z * model.n + np.array(rest, np.int64)
        return pa.array((y * y).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
    y = z.astype(object) * model.n + np.array(rest, object)
    whole = (y * y).sum(axis=1).tolist()
    return pa.array([Decimal(v) if v < 10**38 else None for v in whole], pa.decimal128(38, 0))


def identity_errors(vectors: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Per vector length: largest entry of the whitened values' covariance minus the identity, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in whole_numbers(batch.column(0)):
                w = project(models[x.shape[1]], x)
                own = np.vstack([w.T @ w, w.sum(axis=0)])
                held[x.shape[1]] = held.get(x.shape[1], 0.0) + own
        for d, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * own.size, pa.int32()), pa.array(np.arange(own.size), pa.int64()), pa.array(own.ravel())], ["d", "place", "v"])

    parts = vectors.mapInArrow(run, "d int, place long, v double").groupBy("d", "place").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for d, own in parts.groupby("d"):
        model = models[d]
        k = model.components.shape[1]
        table = own.sort_values("place")["v"].to_numpy().reshape(k + 1, k)
        # Whitened values are centred already: their mean is what rounding left.
        mean = table[k] / model.n
        full = model.scale > 0
        error = np.abs(table[:k] / model.n - np.outer(mean, mean) - np.eye(k))[np.ix_(full, full)]
        out[int(d)] = float(error.max()) if error.size else None
    return out


def whiten(frame: DataFrame, key: str, vector: str | Column) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per usable vector and component.

    ``deviation`` is a decimal of 38 digits.
    """
    vectors = frame.select(F.col(vector) if isinstance(vector, str) else vector)
    models = fit(vectors)
    errors = identity_errors(vectors, models) if models else {}
    out = T.StructType(
        [
            T.StructField("id", frame.schema[key].dataType),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.DecimalType(38, 0)),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in whole_numbers(batch.column(1)):
                model = models[x.shape[1]]
                w, k, m = project(model, x), model.components.shape[1], len(rows)
                each = pa.array(np.repeat(np.arange(m), k))
                flat = np.tile(model.scale == 0, m)
                share = model.eigenvalues / model.trace if model.trace > 0 else np.zeros(k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n)),
                        deviations(model, x).take(each),
                        pa.array(w.ravel(), mask=flat),
                        pa.array(np.tile(share, m)),
                        pa.array([errors[x.shape[1]]] * (m * k), pa.float64()),
                    ],
                    out.names,
                )

    return frame.select(key, F.col(vector) if isinstance(vector, str) else vector).mapInArrow(run, out)
