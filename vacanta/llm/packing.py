"""Documents packed into token sequences of one length, shortest pack first over the length histogram.

1. Every text is encoded once, and a closing id is added. A document longer than a sequence fills whole
   sequences; its rest, and every shorter document, is one piece. The ids are written as a table of
   blocks, in which each piece has its rank among the block's pieces of that length.
2. The histogram of piece lengths (as many bins as a sequence has tokens) comes to the driver. Lengths
   are placed longest first, always into the packs with the least in them, by counts of packing patterns
   and never piece by piece. Patterns that stay short of a full sequence are then dealt with: the
   emptiest ones are dissolved, and their pieces, in a row, are cut to fill the gaps of the others. What
   is over at the end becomes full sequences and at most one sequence for each power of two. So nothing
   is padded: a sequence is full, or its length is a power of two.
3. Prefix sums over the blocks' counts give every piece its rank among all pieces of its length, without
   a group of one length in one task. The rank tells its slot: a pattern, a copy of it and an offset, or
   a place in the row of dissolved pieces.

The plan's size follows the length of a sequence, not the documents; it is what is broadcast. The ids are
shuffled at most once, by block and length, to meet their ranks.

Encoding equals the tokenizers library (add_special_tokens off). Words are split by the character classes
that the library itself shows for all code points below ``PLAIN``; each distinct word is encoded once per
worker by the library's own model. A text with any other character, or with the string of a special
token, is encoded by the library as a whole.

Defined results: a null or empty text is the closing id alone; every row is a document of its own, also
where ids repeat or are null; a text of any length is cut as above; an empty table gives an empty table;
other columns are ignored. The same table packs in the same way if Spark reads it in the same partitions;
otherwise pieces of one length may change places.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacanta.llm.batches import blocks, flat, for_texts, mix
from vacanta.llm.bpe import byte_letters, ragged
from vacanta.sources.staging import stage

SEQUENCE = 2048
#: Id behind every document.
CLOSING = 1
#: Code points whose class is looked up in a table; composition (NFC) leaves all of them alone.
PLAIN = 0x300
#: Distinct words that a worker remembers before it starts anew, and bits of its look-up table.
REMEMBERED = 2_000_000
LOOKUP_BITS = 22
#: Bytes of ids of a block.
BLOCK_BYTES = 4 << 20

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


# --- encoding -----------------------------------------------------------------------------------


class Words:
    """Encodes texts word by word with one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.whole = Tokenizer.from_file(path)
        # The model alone, for words that are normalised and split already.
        self.model = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        suffix, vocabulary = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.letters = dict(enumerate(byte_letters()))
        self.kind, self.lower = np.full(PLAIN, _OTHER, np.uint8), np.arange(PLAIN, dtype=np.uint32)
        self.plain = np.ones(PLAIN, bool)
        split = self.whole.pre_tokenizer.pre_tokenize_str
        for point in range(PLAIN):
            c = chr(point)
            low = self.whole.normalizer.normalize_str(c)
            self.plain[point] = len(low) == 1
            self.lower[point] = ord(low[0])
            parts = len(split(f"a{c}a"))
            self.kind[point] = {1: _LETTER, 2: _SPACE}.get(parts, _NUMBER if len(split(c + c)) == 2 else _OTHER)
        rng = np.random.default_rng(7)
        # Values of the lowered code points; lower() may lead out of the plain ones.
        self.value = mix(self.lower.astype(np.uint64) * np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1))
        self.up, self.down = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.forget()

    def forget(self) -> None:
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        # Open addressing; 0 is a free slot.
        self.slot_hash = np.zeros(1 << LOOKUP_BITS, np.uint64)
        self.slot_code = np.zeros(1 << LOOKUP_BITS, np.int32)
        self.bits = LOOKUP_BITS

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, _BASE_INVERSE))
        return self.up, self.down

    def spans(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all words; ``ends`` are the places of the marks between texts."""
        kind = self.kind[points]
        kind[ends] = _SPACE
        start = np.empty(len(kind), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == _NUMBER
        # An apostrophe that is a mark of its own takes s, t, m, d, re, ve or ll from the word behind it.
        at = np.flatnonzero((points == 0x27) & start)
        at = at[at + 1 < len(points)]
        at = at[kind[at + 1] == _LETTER]
        if len(at):
            # A contraction may end where the next one starts; none overlap, as each begins with the mark.
            low = self.lower[points]
            second = low[at + 1]
            third = low[np.minimum(at + 2, len(points) - 1)]
            one = np.isin(second, [ord(c) for c in "stmd"])
            two = ((third == ord("e")) & np.isin(second, [ord("r"), ord("v")])) | ((second == ord("l")) & (third == ord("l")))
            at, size = at[one | two], np.where(one, 2, 3)[one | two]
            start[at + 1] = False
            rest = at + size
            rest = rest[rest < len(points)]
            start[rest] = True
        first = np.flatnonzero(start)
        last = np.append(first[1:], len(kind))
        keep = kind[first] != _SPACE
        return first[keep], last[keep]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the number of ids per text."""
        data, offsets = flat(texts)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        # Places of the marks: one code point per byte that is not the inside of a character.
        inner = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        edges = inner[offsets]
        strange = np.zeros(len(points), bool)
        strange |= points >= PLAIN
        odd = np.minimum(points, PLAIN - 1)
        strange |= ~self.plain[odd]
        for token in self.special:
            head = np.flatnonzero(points[:-1] == ord(token[0]))
            for k, c in enumerate(token[1:], 1):
                head = head[(head + k < len(points))]
                head = head[points[head + k] == ord(c)]
            strange[head] = True
        found = np.concatenate([[0], np.cumsum(strange)])
        alone = np.flatnonzero(found[edges[1:]] > found[edges[:-1]])
        if len(alone):
            odd = odd.copy()
            blank = ragged(edges[alone], edges[alone + 1] - edges[alone])
            odd[blank] = 0x20
        first, last = self.spans(odd, edges[1:] - 1)
        codes = self.codes(odd, first, last)
        size = self.starts[codes + 1] - self.starts[codes]
        ids = self.ids[ragged(self.starts[codes], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        counts = np.diff(ends[np.searchsorted(first, edges)])
        if len(alone):
            whole = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast([texts[int(i)].as_py() for i in alone], add_special_tokens=False)]
            ids = np.insert(ids, np.repeat(np.cumsum(counts)[alone], [len(w) for w in whole]), np.concatenate(whole))
            counts[alone] = [len(w) for w in whole]
        return ids, counts

    def codes(self, points: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Number of each word in the worker's table, by a 64-bit hash."""
        up, down = self.powers(len(points))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(self.value[points] * up[: len(points)], out=sums[1:])
        hashes = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)) | np.uint64(1)
        codes = self.known(hashes)
        missed = np.flatnonzero(codes < 0)
        if len(missed):
            distinct, at, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            size = len(self.starts) - 1
            if size and size + len(distinct) > REMEMBERED:
                self.forget()
                return self.codes(points, first, last)
            own = missed[at]
            self.learn(points, first[own], last[own])
            number = size + np.arange(len(distinct))
            self.remember(distinct, number)
            codes[missed] = number[back]
        return codes

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words, -1 for new ones."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        codes = np.full(len(hashes), -1, np.int64)
        there = self.slot_hash[slot]
        hit = there == hashes
        codes[hit] = self.slot_code[slot[hit]]
        left = np.flatnonzero(~hit & (there != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.slot_hash[slot]
            hit = there == hashes[left]
            codes[left[hit]] = self.slot_code[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], slot[on]
        return codes

    def remember(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Put new distinct words into the table, which stays half empty."""
        bits = max(LOOKUP_BITS, (2 * len(self.starts)).bit_length())
        if bits > self.bits:  # one text with more distinct words than are remembered otherwise
            held = self.slot_hash != 0
            hashes, numbers = np.concatenate([self.slot_hash[held], hashes]), np.concatenate([self.slot_code[held], numbers])
            self.bits, self.slot_hash, self.slot_code = bits, np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.slot_hash[slot[left]] == 0]
            self.slot_hash[slot[free]] = hashes[free]
            won = self.slot_hash[slot[left]] == hashes[left]
            self.slot_code[slot[left[won]]] = numbers[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def learn(self, points: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """Add words that are new to the table, in this order."""
        low = self.lower[points[ragged(first, last - first)]]
        parted = np.insert(low, np.cumsum(last - first)[:-1], 0x20)
        letters = parted.astype("<u4").tobytes().decode("utf-32-le").encode().decode("latin-1").translate(self.letters | {0x20: " "}).split(" ")
        step = 1000
        some = self.model.encode_batch_fast([" ".join(letters[i : i + step]) for i in range(0, len(letters), step)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in some])
        ends = np.flatnonzero(self.closes[ids]) + 1
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends])
        self.ids = np.concatenate([self.ids, ids])


_WORDS: dict[str, Words] = {}


def encoder(path: str) -> Words:
    """The worker's encoder of a tokenizer file."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


# --- plan ---------------------------------------------------------------------------------------


@dataclass
class Plan:
    """Slots of pieces by length and rank, and the gaps that the row of dissolved pieces fills.

    A slot has ``count`` sequences from ``sequence`` on and ``times`` pieces in each of them, the first
    at ``offset``; the pieces of one rank range go round the sequences. A slot with sequence -1 lies in
    the row, from place ``offset`` on. A gap group has ``gap_count`` sequences with a gap of one size.
    """

    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    gap_place: list[int] = field(default_factory=list)
    gap_size: list[int] = field(default_factory=list)
    gap_count: list[int] = field(default_factory=list)
    gap_sequence: list[int] = field(default_factory=list)
    gap_offset: list[int] = field(default_factory=list)


@dataclass
class Pattern:
    """Pieces (length, times) of a pack and the number of packs that look like it."""

    parts: tuple
    filled: int
    count: int


def packed(histogram: dict[int, int], most: int = SEQUENCE) -> list[Pattern]:
    """Shortest pack first: lengths from the longest down, always into the packs with the most space."""
    by_space: dict[int, list[Pattern]] = {}

    def put(pattern: Pattern) -> None:
        by_space.setdefault(most - pattern.filled, []).append(pattern)

    for length in sorted((k for k, n in histogram.items() if n and 0 < k <= most), reverse=True):
        n = histogram[length]
        while n:
            space = max(by_space, default=0)
            if space < length:
                # No pack has space: new ones, filled as the shortest pack would be again and again.
                times = most // length
                if n >= times:
                    put(Pattern(((length, times),), length * times, n // times))
                if n % times:
                    put(Pattern(((length, n % times),), length * (n % times), 1))
                break
            group = by_space[space]
            pattern = group.pop()
            if not group:
                del by_space[space]
            # These packs stay the shortest ones until they are level with the next.
            behind = max(max(by_space, default=0), length - 1)
            times = max(1, min((space - behind) // length, n // pattern.count)) if n >= pattern.count else 1
            hit = min(pattern.count, n)
            put(Pattern((*pattern.parts, (length, times)), pattern.filled + length * times, hit))
            if pattern.count > hit:
                put(Pattern(pattern.parts, pattern.filled, pattern.count - hit))
            n -= hit * times
    return [p for group in by_space.values() for p in group]


def fits(filled: int, most: int) -> bool:
    """Whether a sequence of this length needs no padding."""
    return filled == most or filled & (filled - 1) == 0


def make_plan(histogram: dict[int, int], most: int = SEQUENCE) -> Plan:
    """Slots for every piece of the histogram; sequences are numbered from 0 without a hole."""
    patterns = sorted(packed(histogram, most), key=lambda p: (-p.filled, p.parts))
    settled = [p for p in patterns if fits(p.filled, most)]
    open_ones = [p for p in patterns if not fits(p.filled, most)]
    # The emptiest packs are dissolved until their pieces fill the gaps of all others.
    gaps, row = sum((most - p.filled) * p.count for p in open_ones), 0
    dissolved: list[Pattern] = []
    while open_ones and row < gaps:
        last = open_ones.pop()
        # Every one dissolved adds its pieces to the row and takes its gap away.
        some = min(last.count, -(-(gaps - row) // most))
        dissolved.append(Pattern(last.parts, last.filled, some))
        row, gaps = row + last.filled * some, gaps - (most - last.filled) * some
        if last.count > some:
            open_ones.append(Pattern(last.parts, last.filled, last.count - some))
    plan, ranks, sequence = Plan(), {}, 0

    def slot(length: int, n: int, count: int, first: int, offset: int) -> None:
        plan.length.append(length)
        plan.rank.append(ranks.get(length, 0))
        plan.count.append(count)
        plan.sequence.append(first)
        plan.offset.append(offset)
        ranks[length] = ranks.get(length, 0) + n

    def gap(size: int, count: int, first: int, offset: int) -> None:
        plan.gap_place.append(place)
        plan.gap_size.append(size)
        plan.gap_count.append(count)
        plan.gap_sequence.append(first)
        plan.gap_offset.append(offset)

    place = 0
    for p in (*settled, *open_ones):
        offset = 0
        for length, times in p.parts:
            slot(length, times * p.count, p.count, sequence, offset)
            offset += length * times
        if not fits(p.filled, most):
            gap(most - p.filled, p.count, sequence, p.filled)
            place += (most - p.filled) * p.count
        sequence += p.count
    over = row - place
    for size in (most, *(1 << k for k in reversed(range(most.bit_length())))):
        if count := over // size:
            gap(size, count, sequence, 0)
            place, over, sequence = place + size * count, over - size * count, sequence + count
    place = 0
    for p in dissolved:
        for length, times in p.parts:
            slot(length, times * p.count, 1, -1, place)
            place += length * times * p.count
    return plan


@dataclass
class Places:
    """A plan as sorted arrays."""

    plan: Plan

    def __post_init__(self):
        p = self.plan
        order = np.lexsort((p.rank, p.length))
        self.length, self.rank, self.count, self.sequence, self.offset = (np.array(getattr(p, n), np.int64)[order] for n in ("length", "rank", "count", "sequence", "offset"))
        self.gap_place, self.gap_size, self.gap_count, self.gap_sequence, self.gap_offset = (np.array(getattr(p, f"gap_{n}"), np.int64) for n in ("place", "size", "count", "sequence", "offset"))
        self.gap_first = np.cumsum(self.gap_count) - self.gap_count
        self.first = {int(k): int(np.searchsorted(self.length, k)) for k in np.unique(self.length)}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(piece, start in it, sequence, offset) of every part; a piece outside the row is one part."""
        at = np.empty(len(length), np.int64)
        for k in np.unique(length):
            own = length == k
            low = self.first[int(k)]
            high = np.searchsorted(self.length, k, "right")
            at[own] = low + np.searchsorted(self.rank[low:high], rank[own], "right") - 1
        turn = rank - self.rank[at]
        sequence = self.sequence[at] + turn % self.count[at]
        offset = self.offset[at] + turn // self.count[at] * length
        piece, start = np.arange(len(length)), np.zeros(len(length), np.int64)
        row = np.flatnonzero(self.sequence[at] < 0)
        if not len(row):
            return piece, start, sequence, offset
        low, high = offset[row], offset[row] + length[row]
        from_gap, to_gap = self.gap_of(low), self.gap_of(high - 1)
        parts = to_gap - from_gap + 1
        number = ragged(from_gap, parts)
        group = np.searchsorted(self.gap_first, number, "right") - 1
        turn = number - self.gap_first[group]
        begin = self.gap_place[group] + turn * self.gap_size[group]
        cut = np.maximum(np.repeat(low, parts), begin)
        rest = np.flatnonzero(self.sequence[at] >= 0)
        piece = np.concatenate([rest, np.repeat(row, parts)])
        start = np.concatenate([start[rest], cut - np.repeat(low, parts)])
        sequence = np.concatenate([sequence[rest], self.gap_sequence[group] + turn])
        offset = np.concatenate([offset[rest], self.gap_offset[group] + cut - begin])
        order = np.lexsort((start, piece))
        return piece[order], start[order], sequence[order], offset[order]

    def gap_of(self, place: np.ndarray) -> np.ndarray:
        """Number of the gap, over all groups, that a place of the row falls into."""
        group = np.searchsorted(self.gap_place, place, "right") - 1
        return self.gap_first[group] + (place - self.gap_place[group]) // self.gap_size[group]


# --- pieces -------------------------------------------------------------------------------------


def _binary(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes * ids.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids).view(np.uint8))])


def _turns(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Rank of every value among its equals, on from the counts in ``seen``, which is brought up to date."""
    order = np.argsort(values, kind="stable")
    sorted_values = values[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(values) else np.zeros(0, np.int64)
    turn = np.empty(len(values), np.int64)
    turn[order] = np.arange(len(values)) - np.repeat(first, np.diff(np.append(first, len(values))))
    turn += seen[values]
    seen += np.bincount(values, minlength=len(seen))
    return turn


def encoded_blocks(docs: DataFrame, path: str, key: str, text: str, most: int, closing: int) -> DataFrame:
    """(id, block, ids, doc_tokens, full_turn, rest, rest_turn): ids as 16 or 32 bits, and ranks within the block."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        block, held = (TaskContext.get().partitionId() << 32), 0
        seen, full_seen = np.zeros(most, np.int64), 0
        for whole in batches:
            for start, end in blocks(whole.column(1)):
                ids, counts = words.encode(whole.column(1).slice(start, end - start))
                ids = np.insert(ids, np.cumsum(counts), closing)
                counts = counts + 1
                if held and held + 4 * len(ids) > BLOCK_BYTES:
                    block, held = block + 1, 0
                    seen, full_seen = np.zeros(most, np.int64), 0
                held += 4 * len(ids)
                full, rest = counts // most, counts % most
                turns = full_seen + np.cumsum(full) - full
                full_seen += int(full.sum())
                # 16 bits where they are enough: the first byte tells.
                small = words.closes.size <= 1 << 16 and ids.max(initial=0) < 1 << 16
                yield pa.RecordBatch.from_arrays(
                    [
                        whole.column(0).slice(start, end - start),
                        pa.array(np.full(len(counts), block)),
                        _binary(ids.astype("<u2" if small else "<u4"), counts),
                        pa.array(counts, pa.int64()),
                        pa.array(turns, pa.int64()),
                        pa.array(rest, pa.int32()),
                        pa.array(_turns(rest, seen), pa.int64()),
                    ],
                    ["id", "block", "ids", "doc_tokens", "full_turn", "rest", "rest_turn"],
                )

    schema = T.StructType([T.StructField("id", kind)] + [T.StructField(n, t) for n, t in (("block", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("full_turn", T.LongType()), ("rest", T.IntegerType()), ("rest_turn", T.LongType()))])
    return docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def first_ranks(coded: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """(block, rest, rest_rank, full_rank): ranks that a block's pieces begin at; and the histogram of all pieces."""
    counts = stage(coded.groupBy("block", "rest").agg(F.count("*").alias("n"), F.sum(F.expr(f"doc_tokens div {most}")).alias("n_full")), "pack_counts")
    histogram = {r["rest"]: r["n"] for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    full = counts.groupBy("block").agg(F.sum("n_full").alias("n"))
    # Blocks of a partition first, then the partitions: no window over all blocks in one task.
    parts = full.groupBy(F.expr("block >> 32").alias("part")).agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("part", F.expr("block >> 32")).withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0)))
    full = full.join(parts, "part").select("block", (F.col("base") + F.col("own")).alias("full_rank"))
    rest = Window.partitionBy("rest").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("block", "rest", F.coalesce(F.sum("n").over(rest), F.lit(0)).alias("rest_rank"))
    n_full = counts.agg(F.sum("n_full")).first()[0] or 0
    return stage(ranks.join(full, "block"), "pack_ranks"), histogram | {most: n_full}


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", most: int = SEQUENCE, closing: int = CLOSING) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): a row per piece, ids little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    for_texts(spark)
    coded = stage(encoded_blocks(docs, path, key, text, most, closing), "pack_ids")
    ranks, histogram = first_ranks(coded, most)
    # Whole sequences come first, so their rank is their number.
    plan = spark.sparkContext.broadcast(Places(make_plan({k: n for k, n in histogram.items() if k < most}, most)))
    n_full = histogram[most]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            tokens, rest, full_from, rest_rank = (at[n].to_numpy().astype(np.int64) for n in ("doc_tokens", "rest", "full_at", "rest_at"))
            raw = at["ids"]
            sizes = pc.binary_length(raw).to_numpy().astype(np.int64)
            n, full = len(tokens), tokens // most
            own = np.flatnonzero(rest)
            piece, cut, sequence, offset = plan.value.find(rest[own], rest_rank[own]) if len(own) else [np.zeros(0, np.int64)] * 4
            row = np.concatenate([np.repeat(np.arange(n), full), own[piece]])
            begin = np.concatenate([ragged(np.zeros(n, np.int64), full) * most, full[own[piece]] * most + cut])
            sequence = np.concatenate([ragged(full_from, full), sequence + n_full])
            offset = np.concatenate([np.zeros(int(full.sum()), np.int64), offset])
            order = np.lexsort((begin, row))
            row, begin, sequence, offset = row[order], begin[order], sequence[order], offset[order]
            # A part ends where the next one of its document begins.
            until = np.where(np.append(row[1:] != row[:-1], True), tokens[row], np.append(begin[1:], 0))
            length = until - begin
            wide = sizes // np.maximum(tokens, 1)
            data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, np.uint8)
            places = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + n].astype(np.int64)
            bytes_at = ragged(places[row] + begin * wide[row], length * wide[row])
            if (wide == 2).all():
                ids = data[bytes_at].view("<u2").astype("<u4")
            else:
                ids = np.concatenate([data[places[r] + b * wide[r] : places[r] + (b + m) * wide[r]].view(f"<u{wide[r]}").astype("<u4") for r, b, m in zip(row, begin, length, strict=True)])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [at["id"].take(take), pa.array(begin), pa.array(length), _binary(ids, length), pa.array(tokens[row]), pa.array(sequence), pa.array(offset)],
                ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    # A merge join at any size: whether ids are shuffled must not depend on how many ranks there are.
    placed = coded.join(ranks.hint("merge"), ["block", "rest"]).select(
        "id", "ids", "doc_tokens", "rest", (F.col("full_turn") + F.col("full_rank")).alias("full_at"), (F.col("rest_turn") + F.col("rest_rank")).alias("rest_at")
    )
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())] + [T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset")])
    return placed.mapInArrow(run, schema)
