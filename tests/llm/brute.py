"""Plain versions of the operators, for comparison on small tables, and a table of awkward documents."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

from pyspark.sql import types as T

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TOKEN = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

DOCUMENTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)

PROSE = " ".join(f"alpha{i} beta{i % 7} and the gamma{i % 13}." for i in range(60))
#: Null in every column, empty, white space, marks only, very long, one very long word, repeated rows, equal texts, odd characters.
AWKWARD = [
    (1, PROSE, "en", "s", 1), (1, PROSE, "en", "s", 1), (2, PROSE, "en", None, 1), (3, None, None, None, None), (4, "", "en", "s", 0),
    (5, " \t\n ", "de", "s", 3), (6, "!!! ... ###", None, "s", 5), (7, PROSE + " once more", "en", "s", 9), (8, PROSE * 200, "en", "s", 9),
    (9, "x" * 100_000, "fr", "s", 9), (None, PROSE, "en", "s", 1), (None, None, None, None, None), (10, "one two", "en", "s", 7),
    (11, "one two", "en", "s", 7), (12, "\0 nul\0inside \u2003 \U0001f600 \u00e9\u0301 <|endoftext|> </turn>", "fr", "s", 7), (13, "Z", "de", "s", 1),
]


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def tokens(text: str | None) -> list[str | None]:
    return [*TOKEN.findall((text or "").translate(LOWER)), None]


def shingles(text: str | None, n: int = 5) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def crc(x) -> int:
    return zlib.crc32(("" if x is None else str(x)).encode())


def unite(ids, links) -> dict:
    """Smallest id reachable over links."""
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in up}


def contamination(text: str | None, items: list[tuple], window: int = 13) -> tuple[int, int, list[str]]:
    """n_words, n_hit, item names by trying every place."""
    doc, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for i in range(len(doc) - n + 1):
                if doc[i : i + n] == w[k : k + n]:
                    hit.update(range(i, i + n))
                    names.add("" if name is None else str(name))
    return len(doc), len(hit), sorted(names)


def language_model(texts: list[tuple[bool, str | None]], mass: float, steps: int) -> list[tuple[int, int, int, float, float, float]]:
    """n_tokens, n_known, train_tokens, base score, score and score by pairs of (training, text) rows."""
    single, pair, triple = collections.Counter(), collections.Counter(), collections.Counter()
    for training, text in texts:
        if training:
            t = tokens(text)
            single.update(t)
            pair.update(zip(t, t[1:], strict=False))
            triple.update(zip(t, t[1:], t[2:], strict=False))
    total, distinct = sum(single.values()), len(single)

    def mixed(n: int, before: int, lower: float) -> float:
        own = 2 ** (-math.ceil(-math.log2(n / (before + mass)) * steps - 1e-9) / steps) if n else 0.0
        return own + mass / (before + mass) * lower

    out = []
    for _, text in texts:
        t = tokens(text)
        base = score = by_pairs = 0.0
        for i, w in enumerate(t):
            p = (single[w] + 1) / (total + distinct + 1)
            base += math.log10(p)
            if i and single[t[i - 1]]:
                p = mixed(pair[t[i - 1], w], single[t[i - 1]], p)
            by_pairs += math.log10(p)
            if i > 1 and pair[t[i - 2], t[i - 1]]:
                p = mixed(triple[t[i - 2], t[i - 1], w], pair[t[i - 2], t[i - 1]], p)
            score += math.log10(p)
        out.append((len(t), sum(single[w] > 0 for w in t), total, base, score, by_pairs))
    return out
