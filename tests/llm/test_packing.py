"""Packing: encoding against the library, the plan against single pieces, whole results by reading them back."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from vacanta.llm import packing
from vacanta.llm.batches import table
from vacanta.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encoded(words, texts):
    ids, counts = words.encode(pa.array(texts, pa.string()))
    ends = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


def test_encoding_equals_the_library(library):
    rng = random.Random(2)
    texts = [None, "", "don't we'll they've I'm he'd 's's ''s 12a34", "İstanbul 日本 x", "é <|endoftext|> y", "<|end <|startoftext|>"]
    texts.append("".join(map(chr, range(packing.PLAIN))))
    texts += ["".join(rng.choice("aAsStTlLeErRvVmMdD''' 1.,$\néÉ²\0<|") for _ in range(rng.randrange(40))) for _ in range(2000)]
    wanted = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    words = packing.Words(PATH)
    assert encoded(words, texts) == wanted and encoded(words, texts) == wanted


def test_words_are_forgotten_and_tables_grow(library, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    monkeypatch.setattr(packing, "LOOKUP_BITS", 4)
    rng = random.Random(3)
    texts = [" ".join(f"{rng.choice('abc')}{rng.choice('xyz')}" * rng.randrange(1, 5) for _ in range(60)) for _ in range(20)]
    words = packing.Words(PATH)
    for t in texts:
        assert encoded(words, [t]) == [library.encode(t, add_special_tokens=False).ids]


def one_by_one(lengths, most):
    """Fill of the packs of shortest pack first, piece by piece."""
    packs = []
    for n in sorted(lengths, reverse=True):
        low = min(range(len(packs)), key=packs.__getitem__, default=None)
        if low is None or packs[low] + n > most:
            packs.append(n)
        else:
            packs[low] += n
    return sorted(packs)


HISTOGRAMS = [{}, {1: 1}, {1: 5000}, {30: 7}, {17: 100, 1: 3}, {40: 10, 30: 10, 20: 10}, {33: 1000}, {63: 5, 2: 3, 1: 1}]


@pytest.mark.parametrize("seed", range(len(HISTOGRAMS) + 30))
def test_plan(seed):
    most, rng = 64, random.Random(seed)
    histogram = HISTOGRAMS[seed] if seed < len(HISTOGRAMS) else {rng.randrange(1, most): rng.randrange(1, 4 ** rng.randrange(1, 7)) for _ in range(rng.randrange(1, 40))}
    patterns = packing.packed(histogram, most)
    lengths = [k for k, n in histogram.items() for _ in range(n)]
    assert sorted(p.filled for p in patterns for _ in range(p.count)) == one_by_one(lengths, most) or len(lengths) > 3000
    used = collections.Counter()
    for p in patterns:
        assert p.filled == sum(a * b for a, b in p.parts) <= most
        for a, b in p.parts:
            used[a] += b * p.count
    assert used == {k: n for k, n in histogram.items() if n}
    places = packing.Places(packing.make_plan(histogram, most))
    length = np.array([k for k in sorted(histogram) for _ in range(histogram[k])], np.int64)
    rank = np.concatenate([np.zeros(0, np.int64), *(np.arange(histogram[k]) for k in sorted(histogram))])
    if not len(length):
        return
    piece, start, sequence, offset = places.find(length, rank)
    until = np.where(np.append(piece[1:] != piece[:-1], True), length[piece], np.append(start[1:], 0))
    size = until - start
    assert (size > 0).all() and (np.bincount(piece, size, len(length)) == length).all()
    order = np.lexsort((offset, sequence))
    filled = collections.Counter()
    for s, o, n in zip(sequence[order].tolist(), offset[order].tolist(), size[order].tolist(), strict=True):
        assert filled[s] == o
        filled[s] += n
    assert set(filled) == set(range(len(filled))) and all(packing.fits(n, most) for n in filled.values())
    assert sum(n < most for n in filled.values()) <= 8 + sum(packing.fits(p.filled, most) and p.filled < most for p in patterns for _ in range(p.count))
    assert len(filled) <= len(one_by_one(lengths, most)) + 8 or len(lengths) > 3000


def check(rows, texts, library):
    """``rows`` with ids_crc32; ``texts`` as (id, text), in which an id may repeat."""
    pieces, filled = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
    wanted = collections.defaultdict(list)
    for i, t in texts:
        wanted[i].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    assert set(pieces) == set(wanted)
    for i, own in pieces.items():
        want = collections.Counter()
        spans = collections.Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in own)
        if len(wanted[i]) == 1:
            at, ids = 0, wanted[i][0]
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
                at += r.length
            assert at == len(ids)
            want = collections.Counter((r.start, r.length, zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()), len(ids)) for r in own)
            assert spans == want
        else:
            assert sum(r.length for r in own) == sum(map(len, wanted[i]))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    assert set(filled) == set(range(len(filled)))
    short = sorted(sum(n for _, n in spans) for spans in filled.values() if sum(n for _, n in spans) < 2048)
    total = sum(len(ids) for own in wanted.values() for ids in own)
    assert len(filled) <= total // 2048 + 24, short


def test_query_read_back(spark, sf_dir, library):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    check(QUERIES["op12_packing"](spark, sf_dir).collect(), docs, library)


def test_awkward_and_empty_tables(spark, awkward, nothing, library):
    for docs in (awkward.repartition(3), nothing, awkward.where("text IS NULL"), awkward.where("doc_id = 8")):
        texts = [(r.doc_id, r.text) for r in docs.collect()]
        found = packing.pack(docs.selectExpr("*", "1 AS block", "2 AS ids", "3 AS rest"), PATH).selectExpr("id AS doc_id", "*", "crc32(ids) AS ids_crc32").drop("id")
        check(found.collect(), texts, library)


def test_hot_length_and_many_blocks(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_BYTES", 2000)
    rng = random.Random(4)
    texts = [(i, None if i % 3 == 0 else "word " * rng.choice([5, 5, 900, 2047, 2048, 3000, 5000])) for i in range(900)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    ids = packing.encoded_blocks(docs, PATH, "doc_id", "text", 2048, 1)
    found = packing.pack(docs, PATH).selectExpr("id AS doc_id", "*", "crc32(ids) AS ids_crc32").drop("id")
    check(found.collect(), texts, library)
    assert ids.select("block").distinct().count() >= 7
