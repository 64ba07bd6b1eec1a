"""Spelling variants against all edits of all words."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from vacanta.llm import spelling
from vacanta.llm.batches import table
from vacanta.llm.queries import QUERIES

ALPHABET = [chr(c) for c in [*range(0x61, 0x7B), *range(0x41, 0x5B), *range(0xC0, 0x100)]]


def brute(docs):
    n = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            for e in (w[:i] + w[i + 1 :], *(w[:i] + c + w[i + 1 :] for c in ALPHABET)):
                if e in n and e != w:
                    near[w].add(e)
                    near[e].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o))
        if n[best] >= 10 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


def check(rows, docs):
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    wanted = brute(docs)
    assert got == wanted
    return wanted


def test_query_against_all_edits(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    wanted = check(QUERIES["op13_spelling"](spark, sf_dir).collect(), docs)
    assert any(form for form, *_ in wanted.values())


def planted(seed):
    """Chains of forms, repeated letters, ties, letters beyond ASCII and common words with many variants."""
    rng = random.Random(seed)
    letters = "abÉéÿß"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 12))) for _ in range(25)] + ["aaaaaaaa", "aaaaaaaaa", "bbbbbbbéb", "×÷×÷×÷×"]
    texts = []
    for b in bases:
        weight, word = 300, b
        while weight >= 2:
            texts += [word] * weight
            i = rng.randrange(len(word))
            word = rng.choice([word[:i] + rng.choice(letters) + word[i:], word[:i] + rng.choice(letters) + word[i + 1 :], word[:i] + word[i + 1 :]])
            weight = weight // rng.choice([3, 10, 12])
    rng.shuffle(texts)
    docs = [(i, " ".join(texts[i::40])) for i in range(40)]
    return [*docs, (40, None), (41, ""), (None, "aaaaaaaa AAAAAAAA, aaaaaaab"), (None, "aaaaaaaa AAAAAAAA, aaaaaaab"), (42, "ÀÀÀÀÀÀÀ ààààààà ÀÀÀÀÀÀÀ " + "z" * 5000 + " " + "z" * 5000 + " " + "z" * 4999 + " " + "z" * 4999)]


@pytest.mark.parametrize(("seed", "filter_bytes"), [(1, 1 << 20), (2, 64), (3, 8)])
def test_planted_variants_in_one_or_many_passes(spark, seed, filter_bytes):
    docs = planted(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS word", "'y' AS form").repartition(5)
    wanted = check(spelling.spelling_variants(frame, filter_bytes=filter_bytes).collect(), docs)
    assert any(form and root != form for form, root, *_ in wanted.values())


def test_awkward_and_empty_tables(spark, awkward, nothing):
    check(spelling.spelling_variants(awkward).collect(), [(r.doc_id, r.text) for r in awkward.collect()])
    assert spelling.spelling_variants(nothing).collect() == []


def test_hashes_of_edits_are_those_of_the_edited_words():
    words = ["abcdefgh", "aabbccdd", "éÿßaaaaa"]
    ((_, points),) = spelling.by_length(pa.array(words))
    whole = {w: h for ws in [words] for w, h in zip(ws, spelling.hashes(points), strict=True)}
    assert len(set(whole.values())) == 3

    def of(word):
        return spelling.hashes(np.array([[ord(c) for c in word]]))[0]

    for i, rows, h in spelling.deletions(points):
        assert [of(words[r][:i] + words[r][i + 1 :]) for r in rows] == h.tolist()
    for i, rows, letters, h in spelling.replacements(points):
        assert [of(words[r][:i] + chr(c) + words[r][i + 1 :]) for r, c in zip(rows, letters, strict=True)] == h.tolist()
        assert all(ord(words[r][i]) > c for r, c in zip(rows, letters, strict=True))
        assert [(r, c) for r, w in enumerate(words) for c in spelling.LETTERS.tolist() if c < ord(w[i])] == list(zip(rows.tolist(), letters.tolist(), strict=True))


def test_passes_cover_every_length_within_the_bound():
    sizes = {7: 10, 8: 100_000, 9: 5, 12: 3_000_000}
    found = spelling.passes(sizes, 1 << 20)
    assert all(8 * sum(blocks for *_, blocks in one) <= 1 << 20 for one in found)
    for length, n in sizes.items():
        shards = [(shard, of) for one in found for own, shard, of, _ in one if own == length]
        assert sorted(shards) == [(k, len(shards)) for k in range(len(shards))]
        assert sum(blocks for one in found for own, _, _, blocks in one if own == length) * 64 >= n * spelling.FILTER_BITS
