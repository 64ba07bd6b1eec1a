"""Keyword dictionary and the patterns derived from it.

A dictionary is a parameter, not data: keywords a user lists. It is turned into one prefix-tree
pattern per language, so a text is read once however many keywords there are. Optional plurals are
part of the pattern and not spelled out. A table of forms that is data itself can be matched by a
join (`operators.match.match_by_join`).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from itertools import product

from vacanta.functions.text import normalize_py

LOCAL_LANGUAGES = ("de", "fr", "it")
LANGUAGES = ("en", *LOCAL_LANGUAGES)

# French prepositions, articles and conjunctions that never take a plural "s",
# nor does the word following one.
FRENCH_INVARIANT_WORDS = (
    "de", "du", "des", "par", "pour", "avec", "en", "sur", "dans",
    "la", "le", "les", "et", "ou", "a",
)

# Counterpart forms (plural of a singular entry or the reverse) per keyword for the
# two languages whose plurals follow no suffix rule.
GERMAN_EXTRA_FORMS = {
    "Vector database": ("Vektordatenbanken",),
    "Foundation Model": ("Basismodelle",),
    "Large language model": ("Große Sprachmodelle",),
    "LLM": ("Großes Sprachmodell",),
    "Transformer-based model": ("Transformer-basierte Modelle",),
    "Diffusion Model": ("Diffusionsmodelle",),
    "Generative Model": ("Generative Modelle",),
    "Multimodal models": ("Multimodales Modell",),
    "Generative adversarial networks": ("Generatives gegnerisches Netzwerk",),
    "Neural Networks": ("Neuronales Netz",),
    "Virtual Assistant": ("Virtuelle Assistenten",),
    "AI Adoption": ("KI-Einführungen",),
    "Digital Transformation": ("Digitale Transformationen",),
    "AI Strategy": ("KI-Strategien",),
    "AI Alignment": ("KI-Ausrichtungen",),
    "Embeddings": ("Einbettung",),
    "Chain-of-Thought": ("Gedankenketten",),
}
ITALIAN_EXTRA_FORMS = {
    "Foundation Model": ("Modelli di base",),
    "Multimodal models": ("Modello multimodale",),
    "Vector database": ("Banche dati vettoriali",),
    "Diffusion Model": ("Modelli di diffusione",),
    "Generative Model": ("Modelli generativi",),
    "Transformer-based model": ("Modelli basati su Transformer",),
    "Neural Networks": ("Rete neurale",),
    "Generative adversarial networks": ("Rete avversaria generativa",),
    "Virtual Assistant": ("Assistenti virtuali",),
}
DEFAULT_EXTRA_FORMS: Mapping[str, Mapping[str, tuple[str, ...]]] = {
    "de": GERMAN_EXTRA_FORMS,
    "it": ITALIAN_EXTRA_FORMS,
}


@dataclass(frozen=True)
class Keyword:
    keyword: str
    group: int | None
    source: str
    forms: Mapping[str, str]
    validated: bool = True


@dataclass(frozen=True)
class Dictionary:
    """Keywords with their forms, counterpart forms, exact forms and optional extra patterns.

    ``exact_forms`` maps a keyword to an English form that takes no plural. ``extra_patterns`` maps
    a keyword to a regular expression tried on the normalised text of every ad, on top of its
    forms; its hits count as English ones.
    """

    keywords: tuple[Keyword, ...]
    extra_forms: Mapping[str, Mapping[str, tuple[str, ...]]] = field(
        default_factory=lambda: DEFAULT_EXTRA_FORMS
    )
    extra_patterns: Mapping[str, str] = field(default_factory=dict)
    exact_forms: Mapping[str, str] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.keywords)

    def without(self, names: Iterable[str]) -> Dictionary:
        dropped = set(names)
        return replace(self, keywords=tuple(k for k in self.keywords if k.keyword not in dropped))

    def extended(self, names: Iterable[str], source: str = "new") -> Dictionary:
        """Add English-only candidates. They are matched exactly, without a plural."""
        new = tuple(Keyword(n, None, source, {}, False) for n in names)
        return replace(
            self,
            keywords=self.keywords + new,
            exact_forms={**self.exact_forms, **{n.keyword: n.keyword for n in new}},
        )

    def _forms(self, language: str) -> list[tuple[Keyword, str, bool]]:
        """(keyword, normalised form, whether plurals count) in ``language``."""
        out = []
        for kw in self.keywords:
            english = normalize_py(kw.forms.get("en"))
            form = english if language == "en" else normalize_py(kw.forms.get(language))
            if language == "en" and kw.keyword in self.exact_forms:
                out.append((kw, normalize_py(self.exact_forms[kw.keyword]), False))
            if not form or (language != "en" and form == english):
                continue
            out.append((kw, form, True))
            out += [(kw, normalize_py(f), False) for f in self.extra_forms.get(language, {}).get(kw.keyword, ())]
        return [x for x in out if x[1]]

    def variants(self, language: str) -> dict[str, list[Keyword]]:
        """Every spelling that counts in ``language`` (or as English) with its keywords."""
        out: dict[str, list[Keyword]] = defaultdict(list)
        for kw, form, plural in self._forms(language):
            for spelling in plural_variants(form, language) if plural else [form]:
                if kw not in out[spelling]:
                    out[spelling].append(kw)
        return dict(out)

    def scope(self, language: str | None) -> dict[str, list[Entry]]:
        """Entries for ads of ``language``, English and local, by the stems of their words."""
        out: dict[str, list[Entry]] = defaultdict(list)
        for bucket in ("en", language) if language in LOCAL_LANGUAGES else ("en",):
            for kw, form, plural in self._forms(bucket):
                words = form.split(" ")
                free = plural_words(words, bucket) if plural else set()
                fixed = sum(1 << i for i in range(len(words)) if i not in free)
                ends = sum(1 << i for i, w in enumerate(words) if w != stem(w)) & fixed
                out[" ".join(map(stem, words))].append(Entry(bucket, kw.keyword, kw.group, fixed, ends))
        return dict(out)


@dataclass(frozen=True)
class Entry:
    """A form of a keyword. Bit i of ``ends`` tells whether word i ends in "s", where ``fixed`` has the bit."""

    bucket: str
    keyword: str
    group: int | None
    fixed: int
    ends: int


def stem(word: str) -> str:
    """A word without the "s" at its end; "s" alone stays."""
    return word[:-1] if len(word) > 1 and word.endswith("s") else word


def plural_words(words: list[str], language: str) -> set[int]:
    """Places of the words that may take a plural "s" (see :func:`plural_variants`)."""
    if language == "en":
        places = {len(words) - 1}
    elif language == "fr":
        inert = FRENCH_INVARIANT_WORDS
        places = {i for i, w in enumerate(words) if w not in inert and not (i and words[i - 1] in inert)}
    else:
        places = set()
    return {i for i in places if not words[i].endswith("s")}


def plural_variants(form: str, language: str) -> list[str]:
    """All accepted spellings of a normalised form.

    English: optional "s" on the last word. French: optional "s" on every word that is neither
    invariant nor follows an invariant word. A word ending in "s" takes none. Others: exact.
    """
    words = form.split(" ")
    free = plural_words(words, language)
    return [" ".join(choice) for choice in product(*[[w, w + "s"] if i in free else [w] for i, w in enumerate(words)])]


def prefix_tree_pattern(strings: Iterable[str], gap: str | None = None) -> str:
    """Regular expression for any of ``strings`` that prefers the longest one at a position.

    Common prefixes are written once, so a word is tested against a branch of the tree and not
    against every keyword. ``gap`` replaces each space.
    """
    tree: dict = {}
    for s in strings:
        node = tree
        for ch in s:
            node = node.setdefault(ch, {})
        node[""] = {}

    def render(node: dict) -> str:
        branches = [
            (gap if ch == " " and gap else re.escape(ch)) + render(child)
            for ch, child in sorted(node.items())
            if ch
        ]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        return f"(?:{body})?" if "" in node else body

    return render(tree)


def stem_tree_pattern(stems: Iterable[str], gap: str) -> str:
    """Regular expression for word sequences with any of the given stems that prefers the longest one.

    Every word is its stem and an optional "s". A stem that ends in "s" itself needs that "s": its
    word without it has another stem. So a word of a text fits one branch only.
    """
    tree: dict = {}
    for sequence in stems:
        node = tree
        for i, word in enumerate(sequence.split(" ")):
            if i:
                node = node.setdefault((2, gap), {})
            for ch in word:
                node = node.setdefault((0, re.escape(ch)), {})
            node = node.setdefault((1, "s" if word.endswith("s") and len(word) > 1 else "s?"), {})
        node[(3, "")] = {}

    def render(node: dict) -> str:
        branches = [part + render(child) for (kind, part), child in sorted(node.items()) if kind < 3]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        return f"(?:{body})?" if (3, "") in node else body

    return render(tree)


def longest_first_table(
    dictionary: Dictionary, language: str
) -> dict[str, str]:
    """Canonical spelling to keyword for raw-text matching in ``language``.

    Spellings are lower case with space and hyphen runs as one space. If two keywords share a
    lower-cased form the later one wins; if two forms differ only in hyphens the first one wins.
    """
    by_form: dict[str, str] = {}
    for kw in sorted(dictionary.keywords, key=lambda k: k.keyword):
        english = kw.forms.get("en", "")
        form = english if language == "en" else kw.forms.get(language, "")
        if not form or (language != "en" and form.lower() == english.lower()):
            continue
        by_form[form.lower()] = kw.keyword
    table: dict[str, str] = {}
    for form, keyword in sorted(by_form.items(), key=lambda kv: -len(kv[0])):
        table.setdefault(re.sub(r"[\s\-]+", " ", form), keyword)
    return table


def prefilter_literals(dictionary: Dictionary, min_length: int = 4) -> list[str]:
    """Lower-cased literals one of which a text must contain to be scored at all.

    Each form of at least ``min_length`` characters counts as written and with its spaces as
    hyphens. A literal that contains another one adds nothing and is left out.
    """
    found: set[str] = set()
    for kw in dictionary.keywords:
        for form in (kw.keyword, *kw.forms.values()):
            if form and len(form) >= min_length:
                base = form.lower().strip()
                found |= {base, base.replace(" ", "-")}
    literals = [x for x in found if len(x) >= min_length]
    return sorted(x for x in literals if not any(y != x and y in x for y in literals))
