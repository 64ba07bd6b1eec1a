"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

Words come from the tokenizer file's own split pattern. The distinct new words of a block lie as
symbols in one flat array. A round finds for each word its lowest-rank pair, by binary search over
the sorted pair keys, and merges all its places at once, until no word has a pair left. Results equal
the tokenizers library with ``add_special_tokens=False``; strings of special tokens in a text become
those tokens, as they do there by default.

Defined results: a null or empty text has no tokens and decodes to the empty text. Rows stay as they
are, repeated or not; columns named like an output are replaced; an empty table gives an empty table.
A single text is worked on as a whole whatever its length, so a task's memory grows with its longest text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vacanta.llm.batches import appended, blocks, for_texts, schema_with

#: Split pattern of byte-level BPE; a fixed value of the public format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a task remembers before it starts its table anew.
REMEMBERED = 150_000
_NONE = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The letter that the format writes for each byte: printable bytes stand for themselves."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Codec:
    """Tables of one tokenizer file and the words met so far."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces: list[bytes] = [b""] * size
        for token, at in vocab.items():
            pieces[at] = bytes(byte_of[c] for c in token)
        for token, at in self.special.items():
            pieces[at] = token.encode()
        self.piece_size = np.array([len(p) for p in pieces], np.int64)
        self.piece_start = np.concatenate([[0], np.cumsum(self.piece_size)])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.words = regex.compile(PATTERN)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        for token, at in self.special.items():
            self.known["\0special:" + token] = len(self.known)
            self.ids = np.append(self.ids, np.int32(at))
            self.starts = np.append(self.starts, len(self.ids))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << np.int64(32)) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and the number of ids per word."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_words = [], []
        rank = np.full(len(symbols), _NONE)
        same = word[1:] == word[:-1]
        rank[:-1][same] = self.pair_ranks(symbols[:-1][same], symbols[1:][same])
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(word)))
            lowest = np.minimum.reduceat(rank, first)
            live = lowest < _NONE
            if not live.all():
                stays = np.repeat(live, size)
                done_symbols.append(symbols[~stays])
                done_words.append(word[~stays])
                symbols, word, rank, lowest, size = symbols[stays], word[stays], rank[stays], lowest[live], size[live]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, size))
            # Of places that overlap (a a a) every second one merges, from the left.
            run = np.concatenate([[True], at[1:] != at[:-1] + 1])
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            shift = np.cumsum(keep) - 1
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            at = shift[at]
            changed = np.unique(np.concatenate([at, at[at > 0] - 1]))
            inner = changed[changed + 1 < len(word)]
            rank[changed] = _NONE
            inner = inner[word[inner] == word[inner + 1]]
            rank[inner] = self.pair_ranks(symbols[inner], symbols[inner + 1])
        if not done_symbols:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        flat_symbols, flat_words = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(flat_words, kind="stable")
        return flat_symbols[order].astype(np.int32), np.bincount(flat_words, minlength=len(words))

    def split(self, text: str) -> list[str]:
        """Words of a text; a special token's string is one word with a mark before it."""
        if self.parts is None or not self.parts.search(text):
            return self.words.findall(text)
        out: list[str] = []
        for part in self.parts.split(text):
            if part in self.special:
                out.append("\0special:" + part)
            elif part:
                out.extend(self.words.findall(part))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the number of ids per text."""
        if len(self.known) > REMEMBERED:
            self.forget()
        known, codes, counts, fresh = self.known, [], [], []
        for text in texts:
            words = self.split(text)
            for w in set(words).difference(known):
                known[w] = len(known)
                fresh.append(w)
            codes.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
            counts.append(len(words))
        if fresh:
            ids, sizes = self.merge_words([w.encode() for w in fresh])
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        size = self.starts[code + 1] - self.starts[code]
        ends = np.concatenate([[0], np.cumsum(size)])
        text_ends = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
        return self.ids[ragged(self.starts[code], size)], np.diff(ends[text_ends])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all tokens, flat, and the number of bytes per token; an id outside the vocabulary has none."""
        ids = np.where(ids < len(self.piece_size), ids, 0).astype(np.int64) if len(ids) else ids.astype(np.int64)
        size = self.piece_size[ids]
        return self.piece_bytes[ragged(self.piece_start[ids], size)], size


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every span, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a tokenizer file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _decoded(tokens: Codec, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    data, sizes = tokens.decode(ids)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    rows = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])
    raw = _binary(data, rows)
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:  # ids that are no whole characters
        return pa.array([x.decode(errors="replace") for x in raw.to_pylist()], pa.string())


def encode_texts(docs: DataFrame, path: str, text: str = "text", decode: bool = False) -> DataFrame:
    """``docs`` with n_tokens and ids (little-endian unsigned 32-bit integers); ``decode`` adds the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(path)
        for whole in batches:
            column = whole.column(whole.schema.names.index(text))
            for start, end in blocks(column):
                texts = pc.fill_null(column.slice(start, end - start), "").to_pylist()
                ids, counts = tokens.encode(texts)
                out = {"n_tokens": pa.array(counts, pa.int64()), "ids": _binary(ids.astype("<u4").view(np.uint8), counts * 4)}
                if decode:
                    out["decoded"] = _decoded(tokens, ids, counts)
                yield appended(whole.slice(start, end - start), out)

    for_texts(docs.sparkSession)
    fields = {"n_tokens": T.LongType(), "ids": T.BinaryType()} | ({"decoded": T.StringType()} if decode else {})
    return docs.mapInArrow(run, schema_with(docs, fields))


def decode_ids(frame: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``frame`` with ``decoded``, the text of the binary column ``ids``; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(path)
        for batch in batches:
            values = [np.frombuffer(x or b"", "<u4") for x in batch.column(batch.schema.names.index(ids)).to_pylist()]
            flat_ids = np.concatenate(values) if values else np.zeros(0, np.uint32)
            yield appended(batch, {"decoded": _decoded(tokens, flat_ids, np.array([len(v) for v in values], np.int64))})

    return frame.mapInArrow(run, schema_with(frame, {"decoded": T.StringType()}))
