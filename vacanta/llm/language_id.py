"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 code points of the lower-cased text, weighted by relative
frequency times inverse document frequency. Document frequencies come from all training documents.
Weights are trained with follow-the-regularised-leader (proximal, per-coordinate rates, elastic net:
L1 makes them sparse, L2 keeps them small) on a bounded sample of labelled documents; a further part
of that sample fits one temperature for the probabilities. Prediction reads the text only.

``SAMPLE`` labelled documents per language at most (expected number; chosen by a hash of id and text)
are fitted, whole texts, of which the driver receives hashed counts only: at most 2**BITS numbers each.

Defined results: a null text or one without a letter is ``und`` with score 0; documents without a
language label train nothing; with no training documents at all everything is ``und``; with one
language its score is 1; equal scores go to the first language by name; repeated rows count as often
as they occur; an empty table gives an empty table; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacanta.llm.batches import appended, blocks, for_texts, schema_with

BITS = 15
ORDERS = (1, 2, 3)
#: Labelled documents per language that are fitted, expected number.
SAMPLE = 1500
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _LETTER[0]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lower-cased texts, one after the other, and where each text starts."""
    texts = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = b"" if offsets[-1] == offsets[0] else memoryview(texts.buffers()[2])[offsets[0] : offsets[-1]].tobytes()
    return np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def grams(points: np.ndarray, offsets: np.ndarray, bits: int, orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: hashed n-grams in text order, and where each text's n-grams start."""
    sizes = np.diff(offsets)
    for n in orders:
        if len(points) < n:
            yield np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
            continue
        count = len(points) - n + 1
        h = np.full(count, n, np.uint32)
        for k in range(n):
            h *= np.uint32(0x01000193)
            h += points[k : k + count]
            h ^= h >> np.uint32(13)
        h *= np.uint32(0x9E3779B1)
        h >>= np.uint32(32 - bits)
        if n > 1:  # n-grams that run into the next text
            inside = np.ones(count, bool)
            for k in range(1, n):
                at = offsets[1:] - k
                at = at[(at >= 0) & (at < count)]
                inside[at] = False
            h = h[inside]
            each = np.maximum(sizes - n + 1, 0)
            yield h, np.concatenate([[0], np.cumsum(each)])
        else:
            yield h, offsets


def _counted(texts: pa.Array, bits: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (text, bucket) pairs with their counts."""
    points, offsets = code_points(texts)
    keys = []
    for h, starts in grams(points, offsets, bits, orders):
        text = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(starts))
        keys.append((text << np.uint64(bits)) | h)
    key = np.concatenate(keys)
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    unique = key[at]
    return (unique >> np.uint64(bits)).astype(np.int64), (unique & np.uint64((1 << bits) - 1)).astype(np.int64), np.diff(np.append(at, len(key)))


def document_frequencies(docs: DataFrame, text: str = "text", bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """In how many documents each bucket occurs; the last element is the number of documents.

    Every task sums over its rows before the shuffle, so at most 2**bits + 1 rows leave it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << bits) + 1, np.int64)
        for batch in batches:
            column = batch.column(0)
            for first, last in blocks(column, 1 << 18):
                for start in range(first, last, 64):
                    end = min(start + 64, last)
                    points, offsets = code_points(column.slice(start, end - start))
                    seen = np.zeros((end - start) << bits, bool)
                    for h, starts in grams(points, offsets, bits, orders):
                        seen[np.repeat(np.arange(end - start, dtype=np.int64) << bits, np.diff(starts)) + h] = True
                    total[:-1] += seen.reshape(end - start, -1).sum(axis=0)
                    total[-1] += end - start
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    rows = docs.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((1 << bits) + 1, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


@dataclass
class Model:
    languages: list[str]
    #: (languages, 2**bits): weights times inverse document frequency.
    weights: np.ndarray
    intercept: np.ndarray
    temperature: float
    bits: int = BITS
    orders: tuple[int, ...] = ORDERS

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and probability of each text."""
        points, offsets = code_points(texts)
        n = len(texts)
        has = np.zeros(n, bool)
        if len(points):
            sums = np.concatenate([[0], np.cumsum(letters()[points])])
            has = sums[offsets[1:]] > sums[offsets[:-1]]
        names, score = [UNKNOWN] * n, np.zeros(n)
        if not self.languages or not has.any():
            return names, score
        logits = np.zeros((n, len(self.languages)))
        total = np.zeros(n)
        for h, starts in grams(points, offsets, self.bits, self.orders):
            size = np.diff(starts)
            full = size > 0
            total += size
            if full.any():
                for k in range(len(self.languages)):
                    logits[full, k] += np.add.reduceat(self.weights[k][h], starts[:-1][full], dtype=np.float64)
        logits = logits / np.maximum(total, 1)[:, None] + self.intercept
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        for i in np.flatnonzero(has):
            names[i] = self.languages[best[i]]
        return names, np.where(has, p[np.arange(n), best], 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def follow_the_leader(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_labels: int, size: int,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 4, seed: int = 7,
) -> np.ndarray:
    """Weights (size, n_labels) after FTRL-proximal over sparse rows (index, value) in a fixed random order."""
    z, n = np.zeros((size, n_labels)), np.zeros((size, n_labels))

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            w = weights(at)
            p = softmax((value @ w)[None, :])[0]
            p[labels[i]] -= 1
            g = value[:, None] * p[None, :]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    return weights(np.arange(size))


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on a logarithmic scale."""
    if not len(logits):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).mean())

    low, high, golden = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, text: str = "text", label: str = "lang", key: Column | None = None, sample: int = SAMPLE, bits: int = BITS) -> Model:
    """Fit on the rows of ``docs`` that have a label. ``key`` names rows for the choice of the sample."""
    for_texts(docs.sparkSession)
    size = 1 << bits
    docs = docs.where(F.col(label).isNotNull()).select(F.col(text).alias("_text"), F.col(label).alias("_label"), (key if key is not None else F.col(text)).alias("_key"))
    found = document_frequencies(docs, "_text", bits)
    idf = np.log((1 + found[-1]) / (1 + found[:-1])) + 1
    counts = {r["_label"]: r["n"] for r in docs.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, size), np.float32), np.zeros(0), 1.0, bits)
    # One draw per row: the hash says both whether a row is fitted and whether it calibrates.
    draw = F.pmod(F.xxhash64(F.lit(7), "_key", "_text"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*[F.lit(x) for p in ((k, min(1.0, sample / n)) for k, n in counts.items()) for x in p]), F.col("_label"))
    chosen = docs.withColumn("_draw", draw).where(F.col("_draw") < rate).select("_text", "_label", (F.col("_draw") / rate).alias("_part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in blocks(batch.column(0), 1 << 20):
                row, bucket, n = _counted(batch.column(0).slice(start, end - start), bits, ORDERS)
                cut = np.searchsorted(row, np.arange(end - start + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(start, end - start),
                        batch.column(2).slice(start, end - start),
                        pa.array([bucket[a:b].astype("<u2").tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
                        pa.array([n[a:b].astype("<u4").tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
                    ],
                    ["label", "part", "bucket", "n"],
                )

    rows = chosen.mapInArrow(run, "label string, part double, bucket binary, n binary").orderBy("part", "label").toPandas()
    scale = np.sqrt(size)
    vectors, labels = [], []
    for r in rows.itertuples(index=False):
        at, n = np.frombuffer(r.bucket, "<u2").astype(np.int64), np.frombuffer(r.n, "<u4")
        vectors.append((at, n / max(n.sum(), 1) * idf[at] * scale / 16))
        labels.append(languages.index(r.label))
    labels = np.array(labels, np.int64)
    # The intercept is one more feature that every row has.
    vectors = [(np.append(at, size), np.append(v, 1.0)) for at, v in vectors]
    calibrates = rows["part"].to_numpy() >= 0.8
    fit = np.flatnonzero(~calibrates)
    w = follow_the_leader([vectors[i] for i in fit], labels[fit], len(languages), size + 1)
    held = np.flatnonzero(calibrates)
    logits = np.array([vectors[i][1] @ w[vectors[i][0]] for i in held]).reshape(len(held), len(languages))
    scaled = (w[:size] * idf[:, None] * scale / 16).T.astype(np.float32)
    return Model(languages, np.ascontiguousarray(scaled), w[size], best_temperature(logits, labels[held]), bits)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, from the whole text."""
    for_texts(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits numbers per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            column = whole.column(whole.schema.names.index(text))
            for start, end in blocks(column, 1 << 20):
                names, score = shared.value.predict(column.slice(start, end - start))
                yield appended(whole.slice(start, end - start), {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64())})

    return docs.mapInArrow(run, schema_with(docs, {"lang_pred": T.StringType(), "score": T.DoubleType()}))
