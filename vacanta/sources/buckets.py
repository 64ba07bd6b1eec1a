"""Tables stored in hash buckets of one key, so that joins and groupings on it read without a shuffle.

A relational source whose tables all carry the same key is dealt out once when it arrives: table by table
into the same number of buckets. Every task of the write deals out its own rows, so storing has no shuffle
either. Every later nesting, export or incremental run finds parent and children of a bucket side by side.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vacanta.sources.staging import new_path

#: Rows of a bucket that a store aims at where no number of buckets is given.
ROWS_PER_BUCKET = 2_000_000
#: Files of one write that a store aims at: with more buckets fewer tasks write, but never fewer than there are cores.
FILES_PER_WRITE = 20_000


def bucket_count(n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """A power of two, so that stores of different size still line up by halves."""
    return 1 << max(0, (max(1, n_rows) - 1) // rows_per_bucket).bit_length()


def store_buckets(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None, mode: str = "overwrite") -> DataFrame:
    """Write ``df`` in ``buckets`` by ``key`` under ``path`` and return the table, registered as ``name``.

    A task sorts its rows by bucket and key and writes one file per bucket that it has rows of; nothing is
    shuffled. ``mode`` "append" adds a delivery; it must have the same key and number of buckets. Rows without
    a key share a bucket.
    """
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"not a table name: {name!r}")
    spark = df.sparkSession
    where = path or new_path(spark, name)
    tasks = max(spark.sparkContext.defaultParallelism, FILES_PER_WRITE // buckets)
    df.coalesce(tasks).write.bucketBy(buckets, key).sortBy(key).option("path", where).option("compression", "zstd").mode(mode).format("parquet").saveAsTable(name)
    return spark.table(name)


def open_buckets(spark: SparkSession, name: str, path: str, schema: T.StructType, key: str, buckets: int) -> DataFrame:
    """The table that another session has stored at ``path``, registered as ``name`` in this one."""
    if not re.fullmatch(r"\w+", name) or "'" in path:
        raise ValueError(f"not a table name or path: {name!r}, {path!r}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
