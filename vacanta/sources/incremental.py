"""Incremental processing: redo only partitions whose output does not match their source.

A partition matches if its output has as many rows as its source and the source has the same content as
when the output was written. Content is told by digests that do not depend on row order, kept beside the
output. Rows whose partition value is null are a partition like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacanta.sources.io import write_by
from vacanta.sources.staging import stage

#: Folder of the digests in an output folder; readers of the output pass over names with an underscore.
DIGESTS = "_digests"
_KEPT = (T.StructField("n_source", T.LongType()), T.StructField("total", T.DecimalType(38, 0)), T.StructField("parity", T.LongType()))


def _hashable(c: Column, kind: T.DataType) -> Column:
    """The value in a form that hashes the same whenever it is equal: maps become sorted entries."""
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(_hashable(e["key"], kind.keyType).alias("key"), _hashable(e["value"], kind.valueType).alias("value")))
        return F.array_sort(F.transform(entries, lambda e: F.struct(F.to_json(F.struct(e["key"])), F.to_json(F.struct(e["value"])))))
    if isinstance(kind, T.ArrayType):
        # Hashing skips nulls, so elements carry whether they are one.
        return F.transform(c, lambda e: F.struct(e.isNull(), _hashable(e, kind.elementType)))
    if isinstance(kind, T.StructType):
        return F.struct(*[x for f in kind.fields for x in (c[f.name].isNull(), _hashable(c[f.name], f.dataType))]) if kind.fields else F.lit(0)
    return c


def row_hash(df: DataFrame, seed: int) -> Column:
    """64-bit hash of a row over all columns, in order of their names; tells null from an absent neighbour."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    parts = [x for f in fields for x in (F.col(f"`{f.name}`").isNull(), _hashable(F.col(f"`{f.name}`"), f.dataType))]
    return F.xxhash64(F.lit(seed), *parts)


def partition_digests(df: DataFrame, partition: str) -> DataFrame:
    """(partition, n_source, total, parity): rows, and the sum and the parity of two row hashes, per partition.

    Sums and parities are put together before the shuffle, so a partition with most of the rows costs
    a row per task.
    """
    hashed = df.select(F.col(partition), row_hash(df, 1).alias("_a"), row_hash(df, 2).alias("_b"))
    return hashed.groupBy(partition).agg(F.count(F.lit(1)).alias("n_source"), F.sum(F.col("_a").cast("decimal(20,0)")).cast("decimal(38,0)").alias("total"), F.bit_xor("_b").alias("parity"))


def same_partition(a: DataFrame, b: DataFrame, partition: str) -> Column:
    """Join condition that also brings null partitions together."""
    return a[partition].eqNullSafe(b[partition])


def read_partitioned(spark: SparkSession, path: str, *fields: T.StructField) -> DataFrame | None:
    """The named columns of a written table, partition columns in the given types; None before anything is written."""
    try:
        return spark.read.schema(T.StructType([*fields])).parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def kept_digests(spark: SparkSession, target: str, partition: T.StructField) -> DataFrame | None:
    """Digests that the last write of each partition of ``target`` left."""
    return read_partitioned(spark, f"{target}/{DIGESTS}", *_KEPT, partition)


def writable(df: DataFrame, partition: str) -> DataFrame:
    """``df`` with a partition value that a folder can hold: an empty text is the null partition."""
    if isinstance(df.schema[partition].dataType, T.StringType):
        return df.withColumn(partition, F.nullif(F.col(partition), F.lit("")))
    return df


def stale_partitions(source: DataFrame, done: DataFrame | None, partition: str, kept: DataFrame | None = None) -> DataFrame:
    """(partition, n_source, n_done): partitions of the source without output, or with another number of rows.

    With ``kept`` digests, also those whose content has changed since, or whose digest is missing.
    """
    src = partition_digests(source, partition) if kept is not None else source.groupBy(partition).agg(F.count(F.lit(1)).alias("n_source"))
    return _stale(src, done, partition, kept)


def _stale(src: DataFrame, done: DataFrame | None, partition: str, kept: DataFrame | None) -> DataFrame:
    if done is None:
        return src.select(partition, "n_source", F.lit(None).cast("long").alias("n_done"))
    out = done.groupBy(F.col(partition).alias("_p")).agg(F.count(F.lit(1)).alias("n_done"))
    found = src.join(out, F.col(partition).eqNullSafe(F.col("_p")), "left").drop("_p")
    stale = ~F.col("n_source").eqNullSafe(F.col("n_done"))
    if kept is not None:
        was = kept.select(F.col(partition).alias("_p"), F.col("total").alias("_total"), F.col("parity").alias("_parity"))
        found = found.join(was, F.col(partition).eqNullSafe(F.col("_p")), "left")
        stale = stale | ~(F.col("total").eqNullSafe(F.col("_total")) & F.col("parity").eqNullSafe(F.col("_parity")))
    return found.where(stale).select(partition, "n_source", "n_done")


def process_stale(
    source: DataFrame,
    done: DataFrame | None,
    partition: str,
    job: Callable[[DataFrame], DataFrame],
    target: str,
) -> DataFrame:
    """Run a row-preserving job on stale partitions only and replace their output; returns what was stale.

    Digests are taken once and staged before anything is written, as staleness is derived from the
    output that is about to be replaced. They are written last: a call that was cut off leaves the old
    digest, or none, and the partition is done again.
    """
    spark, field = source.sparkSession, source.schema[partition]
    kept = kept_digests(spark, target, field)
    digests = stage(partition_digests(source, partition), "digests")
    if kept is None:
        kept = spark.createDataFrame([], T.StructType([*_KEPT, field]))
    stale = stage(_stale(digests, done, partition, kept), "stale")
    if stale.isEmpty():
        return stale
    write_by(job(source.join(stale, same_partition(source, stale, partition), "left_semi")), target, partition)
    write_by(digests.join(stale.select(F.col(partition).alias("_p")), F.col(partition).eqNullSafe(F.col("_p")), "left_semi").coalesce(1), f"{target}/{DIGESTS}", partition)
    return stale


def with_language(df: DataFrame, source: str = "language") -> DataFrame:
    """Add the language tag unless the table already has it."""
    if "detected_language" in df.columns:
        return df
    return df.withColumn("detected_language", F.col(source))
