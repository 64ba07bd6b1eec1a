"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

Words are the runs of letters of whole texts, with a planted slip: where a checksum of document and run
allows it, one letter is deleted. They are counted over all documents. Every word then generates its
neighbourhood, and each edit is looked up in Bloom filters of the vocabulary before anything is shuffled.
Only edits that a filter has meet the vocabulary, in an exact join on the edited word, which removes what
the filter had by chance.

A pair of near words is generated once: the longer word deletes (one of a run of equal letters), and of
two words of one length the one with the larger letter replaces it by all smaller ones, which are few for
a-z. Hashes of edits
come from prefix sums of the word's polynomial hash, so an edit costs the same at any word length, and
the edited word is only written out once a filter has it.

Filters are sharded by word length, and beyond ``FILTER_BYTES`` by hash. They are broadcast in passes of
at most ``FILTER_BYTES`` each, whatever the vocabulary. A pass generates only edits of its own lengths,
so passes over lengths repeat no work. A block of a filter is one 64-bit number, filled on Spark by
partial ``bit_or``; the driver only strings together packed segments of one pass at a time.

Defined results: null, empty texts and texts without a letter have no words; a null id counts as empty
text in the checksum; repeated rows count every time; ties go to the smallest word in code-point order;
an empty table gives an empty table; other columns are ignored. A run of any length is worked on whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacanta.llm.batches import for_texts, mix
from vacanta.llm.bpe import ragged
from vacanta.sources.staging import stage, unstage

#: Code points of the shortest word, least occurrences, and how many times as frequent a form must be.
LEAST_LENGTH = 7
LEAST_COUNT = 2
FORM_RATIO = 10
#: One in so many (document, run) pairs has a letter deleted.
SLIP = 31
#: All letters of a word: a-z and U+00C0 to U+00FF, and A-Z that are lower-cased.
LETTERS = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], np.uint32)
#: Bits of filter per word, bits set by a word within its block (at most), and bytes of filters in a pass.
FILTER_BITS = 24
FILTER_SET = 5
MASK_BITS = 16
FILTER_BYTES = 32 << 20
#: Blocks (8 bytes) of a packed segment.
SEGMENT = 8192
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000
#: Words that a task probes, about.
PROBED = 50_000
#: Edits that are hashed at once, about.
EDITS = 1 << 18

_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = mix(np.arange(1, 0x101, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_MASKS = np.bitwise_or.reduce(_U(1) << np.random.default_rng(5).integers(0, 64, (1 << MASK_BITS, FILTER_SET)).astype(np.uint64), axis=1)


def slipped(run: str, start: int) -> str:
    """The run, or the run without a letter; ``start`` is the checksum of the document's prefix."""
    h = zlib.crc32(run.encode(), start)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(word, n) of all words of at least ``LEAST_LENGTH`` letters that occur ``LEAST_COUNT`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = body.as_py()
                if not body:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                # bytes.lower() changes A-Z and nothing else.
                for word, n in Counter(_RUN.findall(body.encode().lower().decode())).items():
                    word = slipped(word, start)
                    if len(word) >= LEAST_LENGTH:
                        held[word] += n
                if len(held) > HELD:
                    yield told()
        if held:
            yield told()

    for_texts(docs.sparkSession)
    parts = docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def hashes(points: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of every row of code points; compared within one word length only."""
    return _sums(points)[:, -1]


def _powers(n: int, base: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def _sums(points: np.ndarray) -> np.ndarray:
    """Running polynomial hash: column i is that of the first i letters."""
    n, length = points.shape
    out = np.zeros((n, length + 1), np.uint64)
    np.cumsum(_VALUE[points] * _powers(length, _BASE)[:length], axis=1, out=out[:, 1:])
    return out


def by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, code points) of the words of each length."""
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    start = np.cumsum(length) - length
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        yield rows, points[start[rows][:, None] + np.arange(n)]


def block_and_mask(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of a filter of that many, and the bits that a word has in it."""
    z = (h ^ (h >> _U(31))) * _U(_BASE)
    block = ((z >> _U(32)) * _U(blocks)) >> _U(32)
    return block.view(np.int64), _MASKS[((z >> _U(12)) & _U((1 << MASK_BITS) - 1)).view(np.int64)]


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (mix(h + _U(1)) % _U(shards)).astype(np.int64)


def passes(sizes: dict[int, int], most: int) -> list[list[tuple[int, int, int, int]]]:
    """Filters (length, shard, shards, blocks) of each pass, given the number of words per length."""
    room = most // 8
    out: list[list[tuple[int, int, int, int]]] = []
    left = 0
    for length, n in sorted(sizes.items()):
        wanted = max(1, -(-n * FILTER_BITS // 64))
        shards = -(-wanted // room)
        blocks = -(-wanted // shards)
        for shard in range(shards):
            if blocks > left:
                out.append([])
                left = room
            out[-1].append((length, shard, shards, blocks))
            left -= blocks
    return out


def build_filters(words: DataFrame, wanted: list[tuple[int, int, int, int]]) -> dict[tuple[int, int, int], np.ndarray]:
    """The filters of a pass, as arrays of blocks."""
    base, total = {}, 0
    for length, shard, shards, blocks in wanted:
        base[length, shard, shards] = total
        total += blocks

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, points in by_length(batch.column(0)):
                h = hashes(points)
                for length, shard, shards, blocks in wanted:
                    if length == points.shape[1]:
                        own = h[shard_of(h, shards) == shard] if shards > 1 else h
                        block, mask = block_and_mask(own, blocks)
                        yield pa.RecordBatch.from_arrays([pa.array(block + base[length, shard, shards]), pa.array(mask.view(np.int64))], ["block", "mask"])

    def packed(segment: pa.Table) -> pa.Table:
        at = segment["block"].to_numpy()
        data = np.zeros(SEGMENT, np.int64)
        data[at % SEGMENT] = segment["mask"].to_numpy()
        return pa.table({"segment": pa.array([int(at[0]) // SEGMENT], pa.int64()), "data": pa.array([data.tobytes()], pa.binary())})

    lengths = sorted({f[0] for f in wanted})
    own = words.where(F.length("word").isin(lengths)).select("word")
    blocks = own.mapInArrow(marks, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask"))
    # At most FILTER_BYTES in all, in segments of 64 KB.
    segments = blocks.groupBy(F.expr(f"block div {SEGMENT}").alias("s")).applyInArrow(packed, "segment long, data binary").collect()
    whole = np.zeros(-(-total // SEGMENT) * SEGMENT, np.uint64)
    for row in segments:
        whole[row["segment"] * SEGMENT : (row["segment"] + 1) * SEGMENT] = np.frombuffer(row["data"], np.uint64)
    return {(length, shard, shards): whole[base[length, shard, shards] : base[length, shard, shards] + blocks] for length, shard, shards, blocks in wanted}


def _has(filters: dict, length: int, h: np.ndarray) -> np.ndarray:
    """Which hashes of words of that length the filters of this pass have."""
    found = np.zeros(len(h), bool)
    for (own, shard, shards), blocks in filters.items():
        if own == length:
            block, mask = block_and_mask(h, len(blocks))
            hit = (blocks[block] & mask) == mask
            found |= hit & (shard_of(h, shards) == shard) if shards > 1 else hit
    return found


def deletions(points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, rows, hashes) of words without one letter, once for a run of equal letters."""
    sums, length = _sums(points), points.shape[1]
    for i in range(length):
        rows = np.flatnonzero(points[:, i] != points[:, i + 1]) if i + 1 < length else np.arange(len(points))
        yield i, rows, sums[rows, i] + (sums[rows, -1] - sums[rows, i + 1]) * _U(_INVERSE)


def replacements(points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, rows, letters, hashes) of words with one letter replaced by a smaller one."""
    sums, length = hashes(points), points.shape[1]
    powers = _powers(length, _BASE)
    smaller = np.searchsorted(LETTERS, np.arange(0x100))
    for i in range(length):
        size = smaller[points[:, i]]
        rows = np.repeat(np.arange(len(points)), size)
        letters = ragged(np.zeros(len(points), np.int64), size)
        rest = sums - _VALUE[points[:, i]] * powers[i]
        yield i, rows, LETTERS[letters], rest[rows] + (_VALUE[LETTERS] * powers[i])[letters]


def candidates(words: DataFrame, wanted: list[tuple[int, int, int, int]], filters, total: int) -> DataFrame:
    """(word, n, edit): edits that the filters of a pass have."""
    lengths = {f[0] for f in wanted}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = filters.value

        def told(batch: pa.RecordBatch, rows: np.ndarray, edited: np.ndarray) -> pa.RecordBatch:
            take, size = pa.array(rows), edited.shape[1]
            joined = np.ascontiguousarray(edited, "<u4").tobytes().decode("utf-32-le")
            edits = pa.array([joined[k : k + size] for k in range(0, len(joined), size)], pa.string())
            return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), edits], ["word", "n", "edit"])

        for batch in batches:
            for at, points in by_length(batch.column(0)):
                length = points.shape[1]
                step = max(1, EDITS // max(len(LETTERS), length))
                for k in range(0, len(at), step):
                    rows, some = at[k : k + step], points[k : k + step]
                    if length - 1 in lengths:
                        for i, which, h in deletions(some):
                            hit = which[_has(own, length - 1, h)]
                            if len(hit):
                                yield told(batch, rows[hit], np.delete(some[hit], i, axis=1))
                    if length in lengths:
                        for i, which, letters, h in replacements(some):
                            found = np.flatnonzero(_has(own, length, h))
                            if len(found):
                                hit = which[found]
                                edited = some[hit]
                                edited[:, i] = letters[found]
                                yield told(batch, rows[hit], edited)

    near = words.where(F.length("word").isin(sorted(lengths | {n + 1 for n in lengths})))
    # A word takes far more work than reading it: tasks by number of words, not by file size.
    near = near.repartition(max(1, -(-total // PROBED)), "word")
    return near.mapInArrow(run, "word string, n long, edit string")


def near_words(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, other, other_n): every pair of words one edit apart, once."""
    spark = words.sparkSession
    sizes = {r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    found = None
    for wanted in passes(sizes, filter_bytes):
        filters = spark.sparkContext.broadcast(build_filters(words, wanted))
        own = {length for length, *_ in wanted}
        some = candidates(words, wanted, filters, sum(n for length, n in sizes.items() if length in own or length - 1 in own))
        found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], "word string, n long, other string, other_n long")
    return found.join(words.select(F.col("word").alias("edit"), F.col("n").alias("other_n")), "edit").select("word", "n", F.col("edit").alias("other"), "other_n")


def forms(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, n_near) of words with near words, and (word, form, form_n) of those with a frequent enough one."""
    both = near.unionByName(near.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    # Few pairs can decide a form: the names themselves are compared for those only.
    frequent = both.where(F.col("other_n") >= FORM_RATIO * F.col("n"))
    best = frequent.groupBy("word").agg(F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    return both.groupBy("word").agg(F.count("*").alias("n_near")), best.select("word", F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(linked: DataFrame) -> DataFrame:
    """(word, root) of words with a form, by pointer jumping: a form is more frequent, so chains end."""
    at = stage(linked.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.join(at.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
        moved = stage(onward.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        ended = moved.where("moved").isEmpty()
        unstage(at.sparkSession, at)
        at = moved.select("word", "root")
        if ended:
            return at


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = stage(word_counts(docs, key, text), "words")
    near = stage(near_words(words, filter_bytes), "near")
    counts, best = forms(near)
    linked = stage(best, "forms")
    found = words.join(counts, "word", "left").join(linked, "word", "left").join(roots(linked), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
