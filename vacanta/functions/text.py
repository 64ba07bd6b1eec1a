"""Text normalisation as Spark column expressions.

Everything here stays on the JVM. The character tables are derived once on the driver from
``unicodedata`` by rule, so they are the same on every executor.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# German digraphs, applied before decomposition, so only to precomposed letters.
GERMAN_DIGRAPHS = {"ü": "ue", "ö": "oe", "ä": "ae", "ß": "ss"}
# Apostrophes that vanish without leaving a gap.
APOSTROPHES = "'’"

_KEPT = set("abcdefghijklmnopqrstuvwxyz0123456789")


def _nfkd_base(ch: str) -> str:
    """Compatibility decomposition of one character without its combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


# Frequent characters that fold to nothing: texts whose other characters are all folded by the
# one-character table skip the rare step.
_COMMON_GAPS = "‘“”„–—•…€«»°·´"
_NON_ASCII = r"[^\x00-\x7F]"
_NOT_ASCII = r"(?![\x00-\x7F])"


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, dict[str, str], dict[str, str]]:
    """(deleted characters, one-character folds, longer folds) over all of Unicode.

    Only characters whose decomposition keeps a letter, digit or apostrophe need an entry: all
    others turn into a gap with or without folding.
    """
    deleted: list[str] = list(APOSTROPHES)
    single: dict[str, str] = {}
    multi: dict[str, str] = {}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if 0xD800 <= cp <= 0xDFFF or ch in GERMAN_DIGRAPHS or ch in APOSTROPHES:
            continue
        if not unicodedata.combining(ch) and unicodedata.is_normalized("NFKD", ch):
            continue
        # Inside a longer fold everything that is not kept is already a gap.
        base = "".join(
            c if c in _KEPT else " " for c in _nfkd_base(ch) if c not in APOSTROPHES
        )
        if not base:
            deleted.append(ch)
        elif base.strip():
            (single if len(base) == 1 else multi)[ch] = base
    return "".join(deleted), single, multi


def _char_class(chars: str) -> str:
    ranges: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if ranges and cp == ranges[-1][1] + 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def _fold_non_ascii(text: Column) -> Column:
    deleted, single, multi = _fold_tables()
    for letter, digraph in GERMAN_DIGRAPHS.items():
        text = F.replace(text, F.lit(letter), F.lit(digraph))
    text = F.translate(text, "".join(single) + deleted, "".join(single.values()))
    # Ligatures, fractions, unit signs: one loop over a literal table, entered only if a member
    # occurs at all. The look-aheads keep the wide classes off the ASCII characters.
    table = json_literal(
        [{"k": k, "v": v} for k, v in multi.items()], "array<struct<k:string,v:string>>"
    )

    def rare(t: Column) -> Column:
        loop = F.aggregate(table, t, lambda acc, x: F.replace(acc, x["k"], x["v"]))
        return F.when(
            t.rlike(f"{_NOT_ASCII}[^{_COMMON_GAPS}]"),
            F.when(t.rlike(f"{_NOT_ASCII}[{_char_class(''.join(multi))}]"), loop).otherwise(t),
        ).otherwise(t)

    return _let(text, rare)


def json_literal(value: object, ddl: str) -> Column:
    """A nested constant; one expression however large, folded by the optimizer."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), ddl)


def fold(text: Column) -> Column:
    """Fold case, umlaut spellings, accents and compatibility forms; drop apostrophes.

    What is outside ``[a-z0-9]`` afterwards only separates words: no upper case and no "_" is
    left, so those characters are exactly ``\\W``. Pure ASCII text skips the folding tables.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    folded = F.when(low.rlike(_NON_ASCII), _fold_non_ascii(low)).otherwise(
        F.replace(low, F.lit("'"), F.lit(""))
    )
    return F.replace(folded, F.lit("_"), F.lit(" "))


def normalize(text: Column) -> Column:
    """Fold case, accents, umlaut spellings, hyphens and punctuation to ``[a-z0-9 ]``.

    Apostrophes vanish, every other run of characters outside ``[a-z0-9]`` becomes one space,
    null becomes the empty string.
    """
    return F.trim(F.regexp_replace(fold(text), r"\W+", " "))


def normalize_py(text: str | None) -> str:
    """Driver-side twin of :func:`normalize` for dictionary forms (a handful of strings)."""
    if not text:
        return ""
    t = text.lower()
    for letter, digraph in GERMAN_DIGRAPHS.items():
        t = t.replace(letter, digraph)
    t = "".join(_nfkd_base(c) for c in t)
    t = "".join(c for c in t if c not in APOSTROPHES)
    return " ".join("".join(c if c in _KEPT else " " for c in t).split())


def preview(text: Column, limit: int = 300) -> Column:
    """One-line preview: strip, newlines to spaces, cut at ``limit`` with an ellipsis."""
    flat = F.replace(
        F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)^\\s+|\\s+$", ""), F.lit("\n"), F.lit(" ")
    )
    return F.when(
        F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))
    ).otherwise(flat)


def list_key(text: Column) -> Column:
    """Key under which candidate lists of several layers are compared."""
    return F.trim(
        F.replace(F.replace(F.lower(text), F.lit("-"), F.lit(" ")), F.lit("  "), F.lit(" "))
    )
