"""Language-model scoring with an n-gram trie in Elias-Fano levels.

The corpus becomes blocks of some megabytes: a block's distinct words and its texts as numbers of
these. Three rounds of requests go from blocks to shards and back:

1. Words. A shard holds a range of word hashes: it sums the training counts that the blocks send,
   keeps the words in a monotone level and answers each block with number and count of its words.
2. Word pairs. A shard holds successors of contexts: it sums the training counts of distinct pairs,
   builds a trie level (contexts, successors relative to their context, quantised probabilities), maps
   it from a file and answers the blocks' pairs by successor search with quantised probabilities.
3. Word triples. Contexts are the word pairs that occur in training, named by their shard and place in the
   second round's level: a block asks for the triples behind these only, with what that round told it, the
   pair's place and training count. Shards work as in the second round.

Blocks lie in buckets of their number: texts never move, answers come to them. Numbers and places rise in
the order of requests and are told as steps; the code of a pair follows from its count and its context's.

Probabilities are p(w | t, u) = c(t, u, w) / (c(t, u) + MASS) + MASS / (c(t, u) + MASS) * p(w | u) behind a
pair that training has, p(w | u) = c(u, w) / (c(u) + MASS) + MASS / (c(u) + MASS) * p(w) behind another known
word, and p(w) = (c(w) + 1) / (N + V + 1) else. The first summands are what the trie stores, rounded down
to steps of 1/``STEPS_PER_OCTAVE`` octave of two bytes: what a context gives to all words together is 1
before and at most 1 after rounding, and at least 96 % of it. ``score`` is the sum of their logarithms;
``pair_score`` is that of the model without its third level.

A block asks once for a pair however often it holds it, so hot words and pairs cost one entry per block;
a frequent context's successors are dealt to several shards by a rule on its total count. What is
gathered are distinct words, pairs and triples per block: it grows with the corpus. Blocks, shards and
answers are bounded; the number of shards follows the corpus.

Tokens are the runs of other characters than space, tab, line feed, vertical tab, form feed and
carriage return after lower-casing A-Z, then one end of text.

Defined results: a null or empty text is its end alone; with no training documents every count is 0;
repeated rows count and are scored as often as they occur; a null training mark is no training; an
empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacanta.llm.batches import LOWER_BYTE, SPACE_BYTE, blocks, flat, for_texts, mix, span_hashes, spans
from vacanta.llm.elias_fano import EliasFano, TrieLevel
from vacanta.sources.buckets import store_buckets
from vacanta.sources.staging import stage

#: Text bytes of a block.
BLOCK = 6 << 20
#: Words that a shard receives, about; of tokens behind pairs twice as many.
SHARD = 1_000_000
#: Training occurrences of a context per part of its successors.
CONTEXT_PART = 100_000
#: Weight of the lower order, in occurrences.
MASS = 3.0
STEPS_PER_OCTAVE = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0x9AE16A3B2F90404F)
_U = np.uint64

BLOCK_SCHEMA = "block long, ids array<long>, training array<boolean>, sizes array<int>, n_words long, words binary, counts binary, tokens binary"


def pack(x: np.ndarray) -> bytes:
    """Compressed bytes of unsigned integers: the byte planes that they need, which suit small and sorted numbers."""
    if not len(x):
        return b""
    width = max(1, -(-int(x.max()).bit_length() // 8))
    planes = np.empty((width, len(x)), np.uint8)
    for k in range(width):
        planes[k] = (x >> x.dtype.type(8 * k)).astype(np.uint8)
    return bytes([width]) + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes, kind: str, n: int) -> np.ndarray:
    kind = np.dtype(kind)
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(memoryview(data)[1:], data[0] * n, "zstd", asbytes=True), np.uint8).reshape(data[0], n)
    out = planes[0].astype(kind)
    for k in range(1, data[0]):
        out |= planes[k].astype(kind) << kind.type(8 * k)
    return out


def pack_tokens(tokens: np.ndarray) -> bytes:
    """Compressed numbers of a block's words, counted as they first occur: a new word is 0, a known one its number and 1."""
    before = np.maximum.accumulate(np.concatenate([[-1], tokens.astype(np.int64)]))[:-1]
    return pack(np.where(tokens > before, 0, tokens + 1).astype(np.uint32))


def unpack_tokens(data: bytes, n: int) -> np.ndarray:
    coded = unpack(data, "u4", n).astype(np.int64)
    new = coded == 0
    return np.where(new, np.cumsum(new) - 1, coded - 1)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key among the distinct ones, and these in order."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    codes = np.empty(len(keys), np.int64)
    codes[order] = np.cumsum(new) - 1
    return codes, ordered[new]


def _by_shard(shard: np.ndarray, bits: int) -> np.ndarray:
    """Stable order by shard."""
    return np.argsort(shard.astype(np.uint16) if bits <= 16 else shard, kind="stable")


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends of texts included, and the number of tokens of each text."""
    hashes, sizes = [], []
    for start, end in blocks(texts):
        data, offsets = flat(texts.slice(start, end - start))
        data = LOWER_BYTE[data]
        inside = ~SPACE_BYTE[data]
        inside[offsets[1:] - 1] = False
        starts, ends = spans(inside)
        n = np.diff(np.searchsorted(starts, offsets))
        out = np.empty(len(starts) + len(n), np.uint64)
        last = np.cumsum(n + 1) - 1
        word = np.ones(len(out), bool)
        word[last] = False
        out[word] = span_hashes(data, starts, ends)
        out[last] = _END
        hashes.append(out)
        sizes.append(n + 1)
    return (np.concatenate(hashes), np.concatenate(sizes)) if sizes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, training, text) to blocks."""
    held: list[pa.RecordBatch] = []
    total, number = 0, 0
    task = TaskContext.get().partitionId()

    def made() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        texts = pa.chunked_array(rows["text"].chunks or [pa.array([], pa.string())]).combine_chunks()
        hashes, sizes = tokens_of(texts)
        tokens, seen = pd.factorize(hashes)
        training = pc.fill_null(rows["training"], False).to_numpy().astype(bool)
        counts = np.bincount(tokens[np.repeat(training, sizes)], minlength=len(seen))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(task << 24) + number], pa.int64()),
                pa.array([rows["id"].to_pylist()], pa.list_(pa.int64())),
                pa.array([training.tolist()], pa.list_(pa.bool_())),
                pa.array([sizes.tolist()], pa.list_(pa.int32())),
                pa.array([len(seen)], pa.int64()),
                pa.array([seen.astype(np.uint64).tobytes()], pa.binary()),
                pa.array([pack(counts.astype(np.uint32))], pa.binary()),
                pa.array([pack_tokens(tokens)], pa.binary()),
            ],
            ["block", "ids", "training", "sizes", "n_words", "words", "counts", "tokens"],
        )

    for batch in batches:
        for start, end in blocks(batch.column("text"), BLOCK):
            held.append(batch.slice(start, end - start))
            total += pc.sum(pc.fill_null(pc.binary_length(held[-1].column("text")), 0)).as_py() or 0
            if total >= BLOCK:
                yield made()
                held, total, number = [], 0, number + 1
    if held and sum(b.num_rows for b in held):
        yield made()


def _word_requests(bits: int):
    """A block's words and training counts, cut by the leading bits of the word hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], np.uint64)
                order = np.argsort(words)
                words, counts = words[order], unpack(row["counts"], "u4", row["n_words"])[order]
                cut = np.searchsorted(words, np.arange(1 << bits, dtype=np.uint64) << _U(64 - bits)) if bits else np.zeros(1, np.int64)
                cut = np.append(cut, len(words))
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int64()),
                        pa.array(np.full(len(full), row["block"]), pa.int64()),
                        pa.array(np.diff(cut)[full], pa.int64()),
                        pa.array([pack(np.diff(words[cut[s] : cut[s + 1]], prepend=_U(0))) for s in full], pa.binary()),
                        pa.array([pack(counts[cut[s] : cut[s + 1]]) for s in full], pa.binary()),
                    ],
                    ["shard", "block", "n", "words", "counts"],
                )

    return run


def _word_shard(bits: int):
    """Sum a shard's training counts, number its words, answer its blocks."""

    def run(table: pa.Table) -> pa.Table:
        shard, rows = table["shard"][0].as_py(), table.to_pylist()
        asked = [np.cumsum(unpack(r["words"], "u8", r["n"])) for r in rows]
        words = np.concatenate(asked)
        counts = np.concatenate([unpack(r["counts"], "u4", r["n"]) for r in rows]).astype(np.int64)
        codes, seen = pd.factorize(words)
        sums = np.bincount(codes, weights=counts, minlength=len(seen)).astype(np.int64)
        known = sums > 0
        names, sums = seen[known], sums[known]
        order = np.argsort(names)
        names, sums = names[order], sums[order]
        base = _U(shard << (64 - bits)) if bits else _U(0)
        level = EliasFano((names - base) >> _U(1 if not bits else 0), 1 << (64 - max(bits, 1)))
        out = []
        for r, own in zip(rows, asked, strict=True):
            at = level.find((own - base) >> _U(1 if not bits else 0))
            found = at >= 0
            number = (at[found] * (1 << bits) + shard + 1).astype(np.uint64)
            if int(number.max(initial=0)) >= 1 << 40:
                raise ValueError("too many words for five-byte numbers")
            count = np.where(found, sums[np.maximum(at, 0)] if len(sums) else 0, 0).astype(np.uint64)
            out.append({"block": r["block"], "shard": shard, "n": r["n"], "numbers": pack(np.diff(number, prepend=_U(0))), "found": pack(count), "total": 0, "distinct": 0})
        out.append({"block": -1, "shard": shard, "n": 0, "numbers": b"", "found": b"", "total": int(sums.sum()), "distinct": len(names)})
        return pa.Table.from_pylist(out, ANSWER)

    return run


ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("numbers", pa.binary()), ("found", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64())])
ANSWER_SCHEMA = "block long, shard long, n long, numbers binary, found binary, total long, distinct long"


def _rising(told: list[dict], found: np.ndarray) -> np.ndarray:
    """Numbers that answers tell as steps, one for each that was found; 0 for the others."""
    out, at = np.zeros(len(found), np.int64), 0
    for a in told:
        there = np.flatnonzero(found[at : at + a["n"]]) + at
        out[there] = np.cumsum(unpack(a["numbers"], "u8", len(there)).astype(np.int64))
        at += a["n"]
    return out


def _found(told: list[dict]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(unpack(a["found"], "u8", a["n"]).astype(np.int64) for a in told)])


class _Pairs:
    """A block's texts as word numbers, and its distinct pairs of known words, in the order of requests."""

    def __init__(self, row: dict, answers: list[dict], bits: int):
        order = np.argsort(np.frombuffer(row["words"], np.uint64))
        found = _found(answers)
        #: Number and training count of each of the block's words.
        self.number, self.count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        self.number[order], self.count[order] = _rising(answers, found > 0), found
        del order, found
        self.by_number = np.argsort(self.number)
        self.rank = np.empty(len(self.number), np.int64)
        self.rank[self.by_number] = np.arange(len(self.number))
        self.sizes = np.array(row["sizes"], np.int64)
        self.training = np.array(row["training"], bool)
        self.tokens = unpack_tokens(row["tokens"], int(self.sizes.sum()))
        starts = np.zeros(len(self.tokens), bool)
        starts[np.cumsum(self.sizes) - self.sizes] = True
        known = self.count[self.tokens] > 0
        self.at = np.flatnonzero(~starts[1:] & known[1:] & known[:-1]) + 1
        del known, starts
        codes, seen = _distinct((self.rank[self.tokens[self.at - 1]] << 32) | self.rank[self.tokens[self.at]])
        left, right = self.by_number[seen >> 32], self.by_number[seen & 0xFFFFFFFF]
        context, word = self.number[left], self.number[right]
        parts = 1 + self.count[left] // CONTEXT_PART
        shard = (mix((context.astype(np.uint64) << _U(20)) + (word % parts).astype(np.uint64)) >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(word), np.int64)
        order = _by_shard(shard, bits)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        #: For every token in ``at``: its pair's place in the order of requests.
        self.pair = place[codes]
        self.shard, self.context, self.word = shard[order], context[order], word[order]
        self.context_count = self.count[left][order]
        in_training = np.repeat(self.training, self.sizes)[self.at]
        self.pair_count = np.bincount(self.pair[in_training], minlength=len(order))


class _Triples:
    """A block's distinct triples of known words behind pairs that training has, in the order of requests."""

    def __init__(self, p: _Pairs, told: list[dict], bits: int):
        pair_count = _found(told)
        place = np.full(len(p.tokens), -1, np.int32)
        place[p.at] = p.pair
        starts = np.zeros(len(p.tokens), bool)
        starts[np.cumsum(p.sizes) - p.sizes] = True
        after = np.flatnonzero(~starts[1:] & (place[:-1] >= 0)) + 1
        del starts
        #: Tokens behind a pair that training has, known or not, and the count of that pair.
        self.after = after[pair_count[place[after - 1]] > 0]
        self.before = pair_count[place[self.after - 1]]
        self.asked = place[self.after] >= 0
        at = self.after[self.asked]
        codes, seen = _distinct((place[at - 1].astype(np.int64) << 32) | p.rank[p.tokens[at]])
        del place
        left = seen >> 32
        word = p.number[p.by_number[seen & 0xFFFFFFFF]]
        # A pair is named by its shard and its place there; both rise in the order of requests.
        context = ((p.shard << 40) | _rising(told, pair_count > 0))[left]
        parts = 1 + pair_count[left] // CONTEXT_PART
        shard = (p.shard[left] + word % parts) & ((1 << bits) - 1)
        order = _by_shard(shard, bits)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        #: For every token asked for: its triple's place in the order of requests.
        self.triple = rank[codes]
        self.shard, self.context, self.word = shard[order], context[order], word[order]
        self.context_count = pair_count[left][order]
        self.count = np.bincount(self.triple[np.repeat(p.training, p.sizes)[at]], minlength=len(order))


def _requests(block: int, bits: int, shard: np.ndarray, contexts: np.ndarray, words: np.ndarray, totals: np.ndarray, counts: np.ndarray) -> list[dict]:
    """A block's sorted contexts and successors by shard.

    The total of a context is sent only where its successors are dealt to several shards; a shard that has
    all of them adds their counts up, for every training occurrence of a context has a known successor.
    """
    out = []
    cut = np.searchsorted(shard, np.arange((1 << bits) + 1))
    for s in np.flatnonzero(np.diff(cut)):
        part = slice(cut[s], cut[s + 1])
        context, word = contexts[part], words[part]
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        size = np.diff(np.append(first, len(context)))
        names, total = context[first], totals[part][first]
        # Words as steps from the one before within their context.
        step = np.diff(word, prepend=0)
        step[first] = word[first]
        out.append(
            {
                "shard": int(s), "block": block, "n": len(word), "n_contexts": len(names),
                "contexts": pack(np.diff(names, prepend=0).astype(np.uint64)), "totals": pack(np.where(total >= CONTEXT_PART, total, 0).astype(np.uint64)),
                "sizes": pack(size.astype(np.uint32)), "words": pack(step.astype(np.uint64)), "counts": pack(counts[part].astype(np.uint32)),
            }
        )
    return out


def _level(told: list[dict], level: int) -> list[dict]:
    return sorted((a for a in told if a["level"] == level), key=lambda a: a["shard"])


def _pair_requests(bits: int):
    """A block and its word answers to its pairs by shard."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            p = _Pairs(row, _level(answers.to_pylist(), 1), bits)
            out += _requests(row["block"], bits, p.shard, p.context, p.word, p.context_count, p.pair_count)
        return pa.Table.from_pylist(out, PAIRS)

    return run


def _triple_requests(bits: int):
    """A block and the answers to its words and pairs to its triples by shard."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        out, told = [], answers.to_pylist()
        for row in block.to_pylist():
            t = _Triples(_Pairs(row, _level(told, 1), bits), _level(told, 2), bits)
            out += _requests(row["block"], bits, t.shard, t.context, t.word, t.context_count, t.count)
        return pa.Table.from_pylist(out, PAIRS)

    return run


PAIRS = pa.schema(
    [("shard", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("n_contexts", pa.int64()), ("contexts", pa.binary()), ("totals", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())]
)
PAIRS_SCHEMA = "shard long, block long, n long, n_contexts long, contexts binary, totals binary, sizes binary, words binary, counts binary"


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes from 1 on of probabilities above 0, rounded down to steps of 1/STEPS_PER_OCTAVE octave.

    Two bytes reach 4,000 octaves, beyond any double.
    """
    return (1 + np.ceil(-np.log2(p) * STEPS_PER_OCTAVE - 1e-9)).astype(np.uint16)


def probability(code: np.ndarray) -> np.ndarray:
    """Probabilities of codes; 0 for code 0."""
    return np.where(code > 0, np.exp2((1.0 - code.astype(np.float64)) / STEPS_PER_OCTAVE), 0.0)


def _request(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, successors per context, words (flat) of a request, and the contexts' total counts."""
    context = np.cumsum(unpack(r["contexts"], "u8", r["n_contexts"]).astype(np.int64))
    size = unpack(r["sizes"], "u4", r["n_contexts"]).astype(np.int64)
    step = np.cumsum(unpack(r["words"], "u8", r["n"]).astype(np.int64))
    first = np.cumsum(size) - size
    before = np.where(first > 0, step[np.maximum(first - 1, 0)], 0)
    return context, size, step - np.repeat(before, size), unpack(r["totals"], "u8", r["n_contexts"]).astype(np.int64)


def _successor_shard(mass: float, counted: bool):
    """Sum a shard's successors, build its trie level, answer its blocks by successor search.

    ``counted``: with places and counts, which name the contexts of the next level and have the quantised
    probability in them; else with the probabilities' codes.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        contexts, words, counts, totals = [], [], [], []
        for r in rows:
            context, size, word, total = _request(r)
            count = unpack(r["counts"], "u4", r["n"])
            seen = count > 0
            contexts.append(np.repeat(context, size)[seen])
            totals.append(np.repeat(total, size)[seen])
            words.append(word[seen])
            counts.append(count[seen])
        context, word, count, total = (np.concatenate(x) for x in (contexts, words, counts, totals))
        order = np.lexsort((word, context))
        context, word, count, total = context[order], word[order], count[order], total[order]
        new = np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])]) if len(context) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        sums = np.add.reduceat(count, at, dtype=np.int64) if len(at) else count
        context, word, total = context[at], word[at], total[at]
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(at) else at
        whole = np.repeat(np.add.reduceat(sums, first), np.diff(np.append(first, len(at)))) if len(at) else total
        code = quantised(sums / (np.where(total > 0, total, whole) + mass))
        level = TrieLevel(context, word, code, int(word.max(initial=0)) + 1)
        del context, word, count, total, whole, contexts, words, counts, totals
        out = []
        for r in rows:
            context, size, word, _ = _request(r)
            inside = word < level.n_words
            found = level.find(context, size, np.where(inside, word, 0))
            there = inside & (found >= 0)
            if counted:
                answer = np.diff(found[there], prepend=0).astype(np.uint64)
                count = pack(np.where(there, sums[np.maximum(found, 0)] if len(sums) else 0, 0).astype(np.uint64))
            else:
                answer, count = np.where(there, code[np.maximum(found, 0)] if len(code) else 0, 0).astype(np.uint16), b""
            out.append({"block": r["block"], "shard": r["shard"], "n": r["n"], "numbers": pack(answer), "found": count, "total": 0, "distinct": 0})
        return pa.Table.from_pylist(out, ANSWER)

    return run


def _scores(bits: int, total: int, distinct: int, mass: float):
    """A block and the answers to its words and pairs to one row per text."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            told = answers.to_pylist()
            p = _Pairs(row, _level(told, 1), bits)
            pairs, triples = _level(told, 2), _level(told, 3)
            pair_count = _found(pairs)
            code = np.zeros(len(pair_count), np.uint16)
            seen = pair_count > 0
            code[seen] = quantised(pair_count[seen] / (p.context_count[seen] + mass))
            count = p.count[p.tokens].astype(np.float64)
            single = (count + 1) / (total + distinct + 1)
            joint = single.copy()
            # A known token behind a known one: what the trie has, and the rest from the word alone.
            before = count[p.at - 1]
            joint[p.at] = probability(code[p.pair]) + mass / (before + mass) * single[p.at]
            # An unknown token behind a known context has the lower order only.
            starts = np.cumsum(p.sizes) - p.sizes
            first = np.zeros(len(p.tokens), bool)
            first[starts] = True
            rest = np.flatnonzero(~first & (count == 0))
            rest = rest[count[rest - 1] > 0]
            joint[rest] = mass / (count[rest - 1] + mass) * single[rest]
            # Behind a pair of training: what the trie's third level has, and the rest from the pair alone.
            third, t = joint.copy(), _Triples(p, pairs, bits)
            code = np.concatenate([np.zeros(0, np.uint16), *(unpack(a["numbers"], "u2", a["n"]) for a in triples)])
            third[t.after] *= mass / (t.before + mass)
            third[t.after[t.asked]] += probability(code[t.triple])
            known = np.add.reduceat((count > 0).astype(np.int64), starts)
            base, by_pairs, score = (np.add.reduceat(np.log10(x), starts) for x in (single, joint, third))
            out.append(
                pa.table(
                    {
                        "id": pa.array(row["ids"], pa.int64()), "training": pa.array(row["training"], pa.bool_()), "n_tokens": pa.array(p.sizes, pa.int64()),
                        "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(len(known), total), pa.int64()),
                        "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64()),
                        "pair_score": pa.array(by_pairs, pa.float64()),
                    }
                )
            )
        return pa.concat_tables(out) if out else SCORE.empty_table()

    return run


SCORE = pa.schema([("id", pa.int64()), ("training", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("pair_score", pa.float64())])
SCORE_SCHEMA = "id long, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, pair_score double"


def _bits(n: int, most: int) -> int:
    """Bits of a shard number so that n things make shards of about ``most``."""
    return max(0, int(np.ceil(np.log2(max(n, 1) / most))))


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", training: str = "training", mass: float = MASS) -> DataFrame:
    """(id, training, n_tokens, n_known, train_tokens, base_score, score, pair_score) per row of ``docs``.

    The model is learnt from the rows whose column ``training`` is true; all rows are scored.
    """
    for_texts(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(training).alias("training"), F.col(text).alias("text"))
    # In buckets of the block: the answers of every round come to it, its texts are never shuffled.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = store_buckets(rows.mapInArrow(_blocks, BLOCK_SCHEMA), f"lm_blocks_{uuid.uuid4().hex}", "block", buckets)
    n_words, n_tokens = made.select(F.sum("n_words"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()
    word_bits, pair_bits = _bits(n_words or 0, SHARD), _bits(n_tokens or 0, 2 * SHARD)
    asked = made.select("block", "n_words", "words", "counts").mapInArrow(_word_requests(word_bits), "shard long, block long, n long, words binary, counts binary")
    words = stage(asked.groupBy("shard").applyInArrow(_word_shard(word_bits), ANSWER_SCHEMA), "lm_words")
    total, distinct = words.where("block = -1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    told = words.where("block >= 0").select("block", "shard", "n", "numbers", "found", F.lit(1).alias("level"))
    texts = made.select("block", "training", "sizes", "words", "tokens").groupBy("block")
    pairs = texts.cogroup(told.groupBy("block")).applyInArrow(_pair_requests(pair_bits), PAIRS_SCHEMA)
    codes = stage(pairs.groupBy("shard").applyInArrow(_successor_shard(mass, True), ANSWER_SCHEMA), "lm_pairs")
    told = told.unionByName(codes.select("block", "shard", "n", "numbers", "found", F.lit(2).alias("level")))
    triples = texts.cogroup(told.groupBy("block")).applyInArrow(_triple_requests(pair_bits), PAIRS_SCHEMA)
    third = triples.groupBy("shard").applyInArrow(_successor_shard(mass, False), ANSWER_SCHEMA)
    told = told.unionByName(third.select("block", "shard", "n", "numbers", "found", F.lit(3).alias("level")))
    texts = made.select("block", "ids", "training", "sizes", "words", "tokens").groupBy("block")
    return texts.cogroup(told.groupBy("block")).applyInArrow(_scores(pair_bits, total, distinct, mass), SCORE_SCHEMA)
