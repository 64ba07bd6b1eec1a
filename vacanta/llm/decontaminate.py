"""Benchmark decontamination with suffix arrays of the training texts.

Each task cuts its documents into shards of about a megabyte and builds a suffix array over a shard's
words. Every suffix of every benchmark text is then looked up by binary search, one word deeper at a
time, which gives its longest verbatim match and all its places in the shard. A match of a whole
window (``window`` words, or all words of a shorter item) is an occurrence.

Words are the runs of digits, a-z and non-ASCII characters after lower-casing A-Z. The benchmark
reaches the tasks in blocks of at most ``BENCHMARK_BYTES``; a larger benchmark adds passes that follow
one another in one stage, so a task never holds more than one block and one shard. There is no shuffle.

Defined results: a null or empty text has no words, no hits and no items; an item without words occurs
nowhere; an item without an id counts as an item named ``""``; items that share an id are one item;
repeated rows are judged alike; an empty table on either side gives no hits. Columns named like an
output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacanta.llm.batches import appended, blocks, flat, for_texts, numbered, restored, schema_with, word_hashes

WINDOW = 13
#: Most bytes of benchmark text that are sent to the tasks at once (one item may be longer).
BENCHMARK_BYTES = 8 << 20

HIT = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
MATCH = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("item_word", T.LongType()),
        T.StructField("doc_word", T.LongType()),
        T.StructField("n_words", T.LongType()),
    ]
)
FIELDS = {"n_words": T.LongType(), "hits": T.ArrayType(HIT), "matches": T.ArrayType(MATCH)}


def suffix_array(rank: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of all suffixes of ``rank``, sorted by their first ``depth`` symbols at least.

    Prefix doubling: a suffix's rank is the first slot of its group of equals; only groups of more
    than one are sorted again, by the rank of what follows.
    """
    n = len(rank)
    order = np.argsort(rank)
    sorted_rank = rank[order]
    change = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
    slot = np.maximum.accumulate(np.where(change, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = slot
    slots = _open_slots(change)
    reach = 1
    while reach < depth and len(slots):
        at = order[slots]
        after = at + reach
        key = rank[at] * np.int64(n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        change = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = slots[np.maximum.accumulate(np.where(change, np.arange(len(at)), 0))]
        slots = slots[_open_slots(change)]
        reach *= 2
    return order


def _open_slots(change: np.ndarray) -> np.ndarray:
    """Indices that share their value with a neighbour, given where a new value begins."""
    follows = np.concatenate([change[1:], [True]])
    return np.flatnonzero(~(change & follows))


def _bound(order: np.ndarray, rank: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray, right: bool) -> np.ndarray:
    """Binary search in [low, high) of the suffix array, by the word at ``depth`` (-1 behind the end)."""
    low, high = low.copy(), high.copy()
    n = len(rank)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) >> 1
        at = order[middle] + depth
        seen = np.where(at < n, rank[np.minimum(at, n - 1)], -1)
        goes_up = seen <= word[open_] if right else seen < word[open_]
        low[open_[goes_up]] = middle[goes_up] + 1
        high[open_[~goes_up]] = middle[~goes_up]


class Benchmark:
    """Words of a block of items, and the windows that start at each word."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        data, offsets = flat(pa.array(texts, pa.large_string()))
        self.words, self.first = word_hashes(data, offsets)
        self.ids = np.array(ids, object)
        self.item = np.repeat(np.arange(len(ids)), np.diff(self.first))
        place = np.arange(len(self.words)) - self.first[self.item] if len(ids) else np.zeros(0, np.int64)
        size = np.diff(self.first)[self.item] if len(ids) else place
        self.place = place
        self.need = np.where(size < window, size, window)
        self.starts = np.flatnonzero(place + self.need <= size)
        self.depth = int(np.diff(self.first).max(initial=0))

    def find(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences in a shard: benchmark word and shard word where a whole window matches.

        ``words`` are the shard's word hashes, ``first`` the first word of each text.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(words) or not len(self.starts):
            return none
        codes, seen = pd.factorize(words)
        asked = pd.Index(seen).get_indexer(self.words)
        if (asked < 0).all():
            return none
        # A mark behind every text keeps matches inside it.
        n_texts = len(first) - 1
        rank = np.zeros(len(words) + n_texts, np.int64)
        spot = np.arange(len(words)) + np.repeat(np.arange(n_texts), np.diff(first))
        rank[spot] = codes + 1
        # A word that the shard does not have equals nothing there, the marks (0) included.
        asked = np.where(asked < 0, -2, asked + 1)
        order = suffix_array(rank, self.depth)
        query = self.starts[asked[self.starts] > 0]
        low, high = np.zeros(len(query), np.int64), np.full(len(query), len(order), np.int64)
        found_word, found_spot = [], []
        depth = 0
        while len(query):
            word = asked[query + depth]
            low, high = _bound(order, rank, low, high, depth, word, False), _bound(order, rank, low, high, depth, word, True)
            depth += 1
            whole = (high > low) & (self.need[query] == depth)
            for i in np.flatnonzero(whole):
                found_spot.append(order[low[i] : high[i]])
                found_word.append(np.full(high[i] - low[i], query[i]))
            # A suffix goes on while it matches and its window is not complete; longer matches follow
            # from windows that are found at neighbouring places.
            live = (high > low) & (self.need[query] > depth)
            query, low, high = query[live], low[live], high[live]
        if not found_spot:
            return none
        spots = np.concatenate(found_spot)
        text = np.searchsorted(first[1:] + np.arange(1, n_texts + 1), spots, side="right")
        return np.concatenate(found_word), spots - text


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, sorted."""
    order = np.lexsort((ends, starts))
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    at = np.flatnonzero(new)
    return starts[at], ends[np.append(at[1:] - 1, len(ends) - 1)]


def _matched(texts: pa.Array, bench: Benchmark) -> list[tuple[int, list[dict], list[dict]]]:
    """n_words, hit spans and maximal matches of each text of one shard."""
    data, offsets = flat(texts)
    words, first = word_hashes(data, offsets)
    word, spot = bench.find(words, first)
    counts = np.diff(first)
    out: list[tuple[int, list[dict], list[dict]]] = [(int(n), [], []) for n in counts]
    if not len(word):
        return out
    # One place between texts, so that spans of neighbouring texts stay apart.
    text = np.searchsorted(first[1:], spot, side="right")
    starts, ends = _merged(spot + text, spot + text + bench.need[word])
    text = np.searchsorted(first[1:] + np.arange(1, len(first)), starts, side="right")
    for t, s, e in zip(text, starts - first[text] - text, ends - first[text] - text, strict=True):
        out[t][1].append({"start": int(s), "end": int(e)})
    # Windows at neighbouring places of item and text are one longer match.
    line = spot - word
    order = np.lexsort((spot, line))
    word, spot, line = word[order], spot[order], line[order]
    item = bench.item[word]
    text = np.searchsorted(first[1:], spot, side="right")
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (spot[1:] != spot[:-1] + 1) | (item[1:] != item[:-1]) | (text[1:] != text[:-1])])
    at = np.flatnonzero(new)
    last = np.append(at[1:] - 1, len(new) - 1)
    for a, z in zip(at, last, strict=True):
        t = text[a]
        out[t][2].append(
            {
                "item_id": bench.ids[item[a]],
                "item_word": int(bench.place[word[a]]),
                "doc_word": int(spot[a] - first[t]),
                "n_words": int(spot[z] + bench.need[word[z]] - spot[a]),
            }
        )
    return out


def _pass(bench: Benchmark, text: str):
    """A mapInArrow function that adds one benchmark block's hits and matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        match = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))
        for whole in batches:
            names = whole.schema.names
            for start, end in blocks(whole.column(names.index(text))):
                batch = whole.slice(start, end - start)
                found = _matched(batch.column(names.index(text)), bench)
                hits, matches = [f[1] for f in found], [f[2] for f in found]
                if "_hits" in names:
                    hits = [a + b for a, b in zip(batch.column(names.index("_hits")).to_pylist(), hits, strict=True)]
                    matches = [a + b for a, b in zip(batch.column(names.index("_matches")).to_pylist(), matches, strict=True)]
                yield appended(
                    batch,
                    {"_n_words": pa.array([f[0] for f in found], pa.int64()), "_hits": pa.array(hits, hit), "_matches": pa.array(matches, match)},
                )

    return run


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BENCHMARK_BYTES, text: str = "text"
) -> DataFrame:
    """``docs`` with n_words, hits (spans of hit words) and matches (maximal verbatim matches per item).

    ``text`` names the texts of ``docs``; ``benchmark`` has item_id and text.
    """
    for_texts(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-size // block_bytes))
    out = docs
    for k in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()
        bench = Benchmark([r["item_id"] for r in rows], [r["text"] for r in rows], window)
        types = {f"_{n}": t for n, t in FIELDS.items()}
        out = out.mapInArrow(_pass(bench, text), schema_with(out, types))
    out = out.select(*docs.columns, "_n_words", "_hits", "_matches").drop(*FIELDS)
    return out.withColumnsRenamed({f"_{n}": n for n in FIELDS}).withColumn("hits", merged_hits("hits") if n_blocks > 1 else F.col("hits"))


def merged_hits(hits: str):
    """Union of hit spans that came from several benchmark blocks."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done, span):
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & (span["start"] <= last["end"])
        grown = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end")))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), grown)).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(F.col(hits)), empty, add)


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """``find_benchmark`` rows with n_hit, items (sorted ids) and contaminated (at least 1 word in ``share`` is hit)."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumns(
        {"n_hit": n_hit, "items": F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))}
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns of ``docs``."""
    renamed, text = numbered(docs, "text")
    found = judged(find_benchmark(renamed, benchmark, window, text=text), share)
    return restored(found.where(~F.col("contaminated")), docs)
