"""Helpers shared by the operators: whole texts of an Arrow batch as flat numpy arrays, and table access.

A batch's texts lie in one byte array with a zero byte behind each text, so that scans never run from
one text into the next. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are worked on at once; a longer single text makes a block of its own.
BLOCK_BYTES = 1 << 20

#: Bytes of a word, `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing: digits, a-z and all of UTF-8's upper half.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x41:0x5B] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[0x41:0x5B] += 0x20
#: Bytes of a token `[^\x20\x09-\x0D]`; zero parts texts and is handled by the caller.
SPACE_BYTE = np.zeros(256, bool)
SPACE_BYTE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []
#: Length of the powers that a worker keeps.
_KEPT = BLOCK_BYTES + (1 << 17)
#: Rows of an Arrow batch: texts are wide, and a batch lies in the JVM and in Python at once.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def for_texts(spark: SparkSession) -> None:
    """Small Arrow batches, so that what a task holds of wide rows stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit("")).cast("string")) % n


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (all operations wrap)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with a zero byte behind each text, and where each text starts (n + 1 offsets)."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = pa.array(["\0"], pa.large_string())[0]
    joined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), ends)
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text, or of one text that is longer."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    yield start, len(sizes)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True. The last element must be False."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: differences of a running polynomial hash, moved to the origin."""
    n = len(data) + 1
    if n <= _KEPT:
        if not _POWERS:
            _POWERS.extend((_powers(_BASE, _KEPT), _powers(_BASE_INVERSE, _KEPT)))
        up, down = _POWERS
    else:  # a long text: not kept
        up, down = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
    sums = np.empty(n, np.uint64)
    sums[0] = 0
    part = _BYTE_VALUE[data]
    part *= up[: n - 1]
    np.cumsum(part, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``flat`` texts in order, and the first word of each text (n + 1 offsets)."""
    data = LOWER_BYTE[data]
    starts, ends = spans(WORD_BYTE[data])
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def appended(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with more columns; one of the same name is replaced."""
    kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n not in columns]
    return pa.RecordBatch.from_arrays([a for _, a in kept] + list(columns.values()), [n for n, _ in kept] + list(columns))


def schema_with(df: DataFrame, fields: dict[str, T.DataType]) -> T.StructType:
    """Schema of ``appended`` rows."""
    return T.StructType([f for f in df.schema.fields if f.name not in fields] + [T.StructField(n, t) for n, t in fields.items()])


def numbered(df: DataFrame, text: str) -> tuple[DataFrame, str]:
    """``df`` with columns c0, c1, ..., which no operator's output can clash with, and the new name of ``text``."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), f"c{df.columns.index(text)}"


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``numbered`` under their first names."""
    return df.select([F.col(f"c{i}").alias(name) for i, name in enumerate(like.columns)])
