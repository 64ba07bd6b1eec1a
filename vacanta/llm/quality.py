"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Expectation-maximisation
over the counts of vote patterns, which cover all documents, estimates each labeller's accuracy on
either class and the share of good documents. The posteriors of the patterns label a bounded sample of
distinct texts, on which a hashed linear scorer (logistic regression on word shapes and word repetition) is
trained; it then scores every whole text. No human label is read.

At most ``SAMPLE`` distinct texts per class, those of the lowest digests, are fitted, each once: copies of
a text neither fill the sample nor keep others out. The driver receives their hashed counts only. Digests
of 128 bits, not texts, are shuffled to find the distinct ones. The pattern table has at most 3 ** labellers rows.

Defined results: a null or empty text, or one without any word, has score 0 and is rejected; repeated
rows are judged alike; an empty table gives an empty table and a model that calls everything with a
word good; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacanta.llm.batches import SPACE_BYTE, appended, blocks, flat, for_texts, mix, schema_with, span_hashes, spans
from vacanta.sources.staging import stage

BITS = 14
#: Distinct texts per class that the scorer is fitted on, at most.
SAMPLE = 4000
#: Added to the number of words that counts are divided by, so that few words are little evidence.
FEW_WORDS = 8
GOOD, BAD, ABSTAIN = 1, 0, 2

#: Byte classes: other, lower, upper, digit, sentence mark, symbol, inner mark, high (non-ASCII letter byte).
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in ".,;:?"]] = 4
_CLASS[[ord(c) for c in "#$%&*@!^~|<>{}[]\\=+_`"]] = 5
_CLASS[[ord(c) for c in "'\"-()/"]] = 6
_CLASS[0x80:] = 7


@dataclass
class Words:
    """What the labellers and the scorer read of a block of texts, one entry per word."""

    text: np.ndarray
    n_texts: int
    counts: np.ndarray
    hashes: np.ndarray
    size: np.ndarray
    by_class: np.ndarray
    #: The word is the one before it, in the same text.
    repeats: np.ndarray
    #: The word occurred before in the same text.
    seen: np.ndarray

    def share(self, of: np.ndarray) -> np.ndarray:
        """Share of each text's words; 0 where there are none."""
        return np.bincount(self.text, weights=of, minlength=self.n_texts) / np.maximum(self.counts, 1)


def words_of(texts: pa.Array) -> Words:
    data, offsets = flat(texts)
    inside = ~SPACE_BYTE[data]
    inside[offsets[1:] - 1] = False
    starts, ends = spans(inside)
    first = np.searchsorted(starts, offsets)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(texts)), counts)
    hashes = span_hashes(data, starts, ends)
    by_class = np.zeros((len(starts), 8), np.int32)
    kinds = _CLASS[data]
    for k in range(1, 8):
        sums = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int32)])
        by_class[:, k] = sums[ends] - sums[starts]
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    seen = pd.Series(mix(hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).duplicated().to_numpy()
    return Words(text, len(texts), counts, hashes, ends - starts, by_class, same, seen)


def _votes_low(x: np.ndarray, good: float, bad: float) -> np.ndarray:
    """Good up to ``good``, bad from ``bad`` on, else abstain."""
    return np.where(x <= good, GOOD, np.where(x >= bad, BAD, ABSTAIN)).astype(np.int8)


def _symbols(w: Words) -> np.ndarray:
    """Words that carry two or more symbols."""
    return _votes_low(w.share(w.by_class[:, 5] >= 2), 0.02, 0.15)


def _symbol_bytes(w: Words) -> np.ndarray:
    symbols = np.bincount(w.text, weights=w.by_class[:, 5], minlength=w.n_texts)
    return _votes_low(symbols / np.maximum(np.bincount(w.text, weights=w.size, minlength=w.n_texts), 1), 0.01, 0.05)


def _upper(w: Words) -> np.ndarray:
    """Words of several capitals without a lower-case letter."""
    return _votes_low(w.share((w.by_class[:, 2] >= 2) & (w.by_class[:, 1] == 0)), 0.05, 0.2)


def _repeats(w: Words) -> np.ndarray:
    """Words equal to the word before them."""
    return _votes_low(w.share(w.repeats), 0.05, 0.2)


def _separators(w: Words) -> np.ndarray:
    """Words of symbols alone, as between cells."""
    return _votes_low(w.share(w.by_class[:, 5] == w.size), 0.02, 0.12)


def _plain(w: Words) -> np.ndarray:
    """Words of letters with a sentence mark at most."""
    letters = w.by_class[:, 1] + w.by_class[:, 2] + w.by_class[:, 7]
    plain = (letters > 0) & (letters + w.by_class[:, 4] + w.by_class[:, 6] == w.size) & ~w.repeats & (w.by_class[:, 2] <= 1)
    share = w.share(plain)
    return np.where(share >= 0.9, GOOD, np.where(share <= 0.7, BAD, ABSTAIN)).astype(np.int8)


def _sentences(w: Words) -> np.ndarray:
    """Sentence ends per word; very long texts without one are lists or noise."""
    share = w.share((w.by_class[:, 4] > 0) & (w.by_class[:, 5] == 0))
    return np.where((share >= 0.04) & (share <= 0.6), GOOD, np.where((share < 0.01) & (w.counts >= 40), BAD, ABSTAIN)).astype(np.int8)


#: The labellers by name.
LABELLERS = {
    "symbols": _symbols,
    "symbol_bytes": _symbol_bytes,
    "upper": _upper,
    "repeats": _repeats,
    "separators": _separators,
    "plain": _plain,
    "sentences": _sentences,
}


def vote(w: Words) -> np.ndarray:
    """(texts, labellers): good, bad or abstain; all abstain on a text without words."""
    votes = np.stack([f(w) for f in LABELLERS.values()], axis=1)
    votes[w.counts == 0] = ABSTAIN
    return votes


def features(w: Words, bits: int = BITS) -> Iterator[np.ndarray]:
    """Hashed features of every word: its shape, its shape with the shape before, its repetition."""
    upper = np.minimum(w.by_class[:, 2], 3)
    shape = (
        (np.minimum(w.by_class[:, 1] + w.by_class[:, 7], 1) << 0) | (upper << 1) | (np.minimum(w.by_class[:, 3], 3) << 3)
        | (np.minimum(w.by_class[:, 4], 2) << 5) | (np.minimum(w.by_class[:, 5], 3) << 7) | (np.minimum(w.by_class[:, 6], 2) << 9)
        | (np.minimum(w.size // 4, 7) << 11)
    ).astype(np.uint64)
    before = np.zeros_like(shape)
    before[1:] = np.where(w.text[1:] == w.text[:-1], shape[:-1] + np.uint64(1), 0)
    shift = np.uint64(64 - bits)
    yield (mix(shape + np.uint64(1 << 20)) >> shift).astype(np.int64)
    yield (mix((shape << np.uint64(20)) + before + np.uint64(1 << 50)) >> shift).astype(np.int64)
    yield (mix(w.repeats.astype(np.uint64) + np.uint64(2) * w.seen.astype(np.uint64) + np.uint64(1 << 60)) >> shift).astype(np.int64)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns.

    Returns the posterior of good per pattern, P(vote | class) as (class, labeller, vote), and the share of good.
    """
    n_labellers = patterns.shape[1]
    good = (patterns == GOOD).sum(axis=1) >= 1.0 * (patterns == BAD).sum(axis=1)
    posterior = np.where(good, 0.9, 0.1)
    table = np.zeros((2, n_labellers, 3))
    share = 0.5
    for _ in range(rounds):
        for c, weight in ((BAD, counts * (1 - posterior)), (GOOD, counts * posterior)):
            for j in range(n_labellers):
                seen = np.bincount(patterns[:, j], weights=weight, minlength=3) + 1e-2
                table[c, j] = seen / seen.sum()
        share = float((counts * posterior).sum() / counts.sum())
        share = min(max(share, 1e-6), 1 - 1e-6)
        log = [np.log(1 - share), np.log(share)]
        for c in (BAD, GOOD):
            log[c] = log[c] + sum(np.log(table[c, j, patterns[:, j]]) for j in range(n_labellers))
        new = 1 / (1 + np.exp(np.clip(log[BAD] - log[GOOD], -500, 500)))
        done = np.abs(new - posterior).max() < 1e-9
        posterior = new
        if done:
            break
    return posterior, table, share


@dataclass
class Model:
    weights: np.ndarray
    intercept: float
    #: Accuracy of each labeller where it votes, on good and on bad documents.
    accuracies: dict[str, tuple[float, float]]
    good_share: float
    bits: int = BITS

    def score(self, w: Words) -> np.ndarray:
        total = np.full(w.n_texts, self.intercept)
        for f in features(w, self.bits):
            total += np.bincount(w.text, weights=self.weights[f], minlength=w.n_texts) / (w.counts + FEW_WORDS)
        return np.where(w.counts > 0, 1 / (1 + np.exp(-np.clip(total, -500, 500))), 0.0)


def fit_linear(
    row: np.ndarray, column: np.ndarray, value: np.ndarray, size: int, target: np.ndarray, weight: np.ndarray,
    l2: float = 1e-3, rounds: int = 300, rate: float = 0.5,
) -> tuple[np.ndarray, float]:
    """Logistic regression with soft targets by gradient descent with per-coordinate rates, on sparse rows."""
    n = len(target)
    w, b = np.zeros(size), 0.0
    gw, gb = np.full(size, 1e-8), 1e-8
    weight = weight / max(weight.sum(), 1e-12)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=value * w[column], minlength=n) + b, -500, 500)))
        e = (p - target) * weight
        g, h = np.bincount(column, weights=value * e[row], minlength=size) + l2 * w / max(n, 1), e.sum()
        gw += g * g
        gb += h * h
        w -= rate * g / np.sqrt(gw)
        b -= rate * h / np.sqrt(gb)
    return w, float(b)


def text_votes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(hi, lo, pattern, n): digest, vote pattern and number of copies of every distinct text with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in blocks(batch.column(0)):
                part = batch.slice(start, end - start)
                w = words_of(part.column(0))
                rows = np.flatnonzero(w.counts > 0)
                votes, at = vote(w)[rows], pa.array(rows)
                yield pa.RecordBatch.from_arrays([part.column(1).take(at), part.column(2).take(at), pa.array([v.tobytes() for v in votes], pa.binary())], ["hi", "lo", "pattern"])

    found = _digested(docs, text).mapInArrow(run, "hi long, lo long, pattern binary")
    return stage(found.groupBy("hi", "lo", "pattern").agg(F.count("*").alias("n")), "text_votes")


def _digested(docs: DataFrame, text: str) -> DataFrame:
    """(text, hi, lo): texts with a digest whose first half is also the draw of the sample."""
    return docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), *(F.xxhash64(F.lit(seed), F.col(text)).alias(name) for seed, name in ((5, "hi"), (6, "lo"))))


def vote_patterns(votes: DataFrame) -> pd.DataFrame:
    """Counts of the vote patterns of all documents with a word, and of their distinct texts."""
    return votes.groupBy("pattern").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).orderBy("pattern").toPandas()


def draw_texts(votes: DataFrame, good: dict[bytes, float], texts: tuple[int, int], sample: int) -> pd.DataFrame:
    """(hi, lo, good) of at most ``sample`` distinct texts per class, those of the lowest digests.

    ``texts`` has the numbers of distinct texts that count as bad and as good.
    """
    # Twice the sample is expected below these; few rows reach the sort.
    below = [-(1 << 63) + min((1 << 64) - 1, int((1 << 64) * min(1.0, 2 * sample / max(n, 1)))) for n in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([good[v] for v in batch.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.float64())], ["hi", "lo", "good"])

    judged = votes.select("hi", "lo", "pattern").mapInArrow(run, "hi long, lo long, good double")
    classes = (judged.where((F.col("good") < 0.5) & (F.col("hi") <= below[0])), judged.where((F.col("good") >= 0.5) & (F.col("hi") <= below[1])))
    return pd.concat([c.orderBy("hi", "lo").limit(sample).toPandas() for c in classes]).sort_values(["hi", "lo"], ignore_index=True)


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE, bits: int = BITS) -> Model:
    """Weak labels from all documents, then the linear scorer on a sample of distinct texts."""
    for_texts(docs.sparkSession)
    votes = text_votes(docs, text)
    found = vote_patterns(votes)
    if not len(found):
        return Model(np.zeros(1 << bits), 1.0, {}, 1.0, bits)
    patterns = np.stack([np.frombuffer(bytes(p), np.int8) for p in found["pattern"]])
    counts, texts = found["n"].to_numpy(float), found["texts"].to_numpy(np.int64)
    posterior, table, share = estimate(patterns, counts)
    accuracies = {name: tuple(float(table[c, j, c] / (table[c, j, GOOD] + table[c, j, BAD])) for c in (GOOD, BAD)) for j, name in enumerate(LABELLERS)}
    known = {bytes(p): float(q) for p, q in zip(found["pattern"], posterior, strict=True)}
    chosen = draw_texts(votes, known, (int(texts[posterior < 0.5].sum()), int(texts[posterior >= 0.5].sum())), sample)
    high, low, good = chosen["hi"].to_numpy(np.int64), chosen["lo"].to_numpy(np.int64), chosen["good"].to_numpy(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = np.ones(len(high), bool)  # a task sends a text once, however many copies it has
        for batch in batches:
            for start, end in blocks(batch.column(0)):
                part = batch.slice(start, end - start)
                hi, lo = part.column(1).to_numpy(), part.column(2).to_numpy()
                at = np.minimum(np.searchsorted(high, hi), len(high) - 1)
                rows = np.flatnonzero((high[at] == hi) & (low[at] == lo))
                _, first = np.unique(at[rows], return_index=True)
                rows = rows[first]
                rows = rows[fresh[at[rows]]]
                if not len(rows):
                    continue
                fresh[at[rows]] = False
                own = words_of(part.column(0).take(pa.array(rows)))
                key = np.sort(np.concatenate([(own.text << bits) | f for f in features(own, bits)]))
                place = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                n = np.diff(np.append(place, len(key)))
                cut = np.searchsorted(key[place] >> bits, np.arange(own.n_texts + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(at[rows], pa.int64()),
                        pa.array(own.counts, pa.int64()),
                        pa.array([(key[place[a:b]] & ((1 << bits) - 1)).astype("<u2").tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
                        pa.array([n[a:b].astype("<u4").tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
                    ],
                    ["chosen", "words", "bucket", "n"],
                )

    drawn = _digested(docs, text).where(F.col("hi") <= int(high.max()))
    rows = drawn.mapInArrow(run, "chosen long, words long, bucket binary, n binary").dropDuplicates(["chosen"]).orderBy("chosen").toPandas()
    buckets = [np.frombuffer(b, "<u2") for b in rows["bucket"]]
    sizes = np.array([len(b) for b in buckets], np.int64)
    row, words = np.repeat(np.arange(len(rows)), sizes), rows["words"].to_numpy(float)
    column = np.concatenate([np.zeros(0, np.int64), *buckets]).astype(np.int64)
    value = np.concatenate([np.zeros(0), *(np.frombuffer(n, "<u4") for n in rows["n"])]) / (words[row] + FEW_WORDS)
    target = good[rows["chosen"].to_numpy(np.int64)]
    # Both classes weigh alike in training; the intercept then gets the share of good documents back.
    weight = np.where(target >= 0.5, 1 / max((target >= 0.5).sum(), 1), 1 / max((target < 0.5).sum(), 1))
    weights, b = fit_linear(row, column, value, 1 << bits, target, weight)
    return Model(weights, b + np.log(share / (1 - share)), accuracies, share, bits)


def score_quality(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with quality (0 to 1), labels (the labellers' votes, g, b or -) and accepted."""
    for_texts(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.array([ord("b"), ord("g"), ord("-")], np.uint8)
        for whole in batches:
            column = whole.column(whole.schema.names.index(text))
            for start, end in blocks(column):
                w = words_of(column.slice(start, end - start))
                score = shared.value.score(w)
                yield appended(
                    whole.slice(start, end - start),
                    {
                        "quality": pa.array(score, pa.float64()),
                        "labels": pa.array([v.tobytes().decode() for v in marks[vote(w)]], pa.string()),
                        "accepted": pa.array(score >= least, pa.bool_()),
                    },
                )

    return docs.mapInArrow(run, schema_with(docs, {"quality": T.DoubleType(), "labels": T.StringType(), "accepted": T.BooleanType()}))
