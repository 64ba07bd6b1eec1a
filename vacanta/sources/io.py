"""Reading and writing of posting tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacanta.sources.staging import stage, unstage
from vacanta.sources.supertypes import common_struct, conform


def scan_shards(spark: SparkSession, *paths: str, at_once: int = 16) -> DataFrame:
    """Parquet shards whose columns may differ; missing columns are null, types become their common one.

    Footers are read by concurrent jobs. Shards of one schema are read together, so many shards make
    few branches, and each branch is cast by itself, so columns and filters still reach its scan.
    """
    with ThreadPoolExecutor(at_once) as pool:
        schemas = list(pool.map(inheritable_thread_target(spark)(lambda path: spark.read.parquet(path).schema), paths))
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for path, schema in zip(paths, schemas, strict=True):
        groups.setdefault(schema.json(), (schema, []))[1].append(path)
    return union_relaxed(*[spark.read.schema(schema).parquet(*found) for schema, found in groups.values()])


def union_relaxed(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by name with missing columns null and differing types, nested ones too, brought to their common one."""
    exact = first.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    schema = first.schema
    for other in others:
        schema = common_struct(schema, other.schema, case_sensitive=exact)
    frames = [conform(df, schema, exact) for df in (first, *others)]
    return reduce(DataFrame.unionAll, frames)


def _table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A written table, or an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


_LEDGER = "file string, length long, modified timestamp, n_rows long, n_bad long, source string, file_id string"
_BAD_LINES = "file string, line string, source string"
#: Files that are read in one pass.
FILES_AT_ONCE = 10_000


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, length, modified) of all files of a pattern, as a table; no content is read.

    Spark lists files on the driver and leaves empty ones out of scans, so these are added by name.
    """
    files = spark.read.format("binaryFile").load(pattern)
    told = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("modified"))
    # Scans write a local path with one slash, lists with three.
    named = spark.createDataFrame([(f,) for f in files.inputFiles()], "file string").withColumn("file", F.regexp_replace("file", r"^(\w+):///", "$1:/"))
    empty = named.join(told.select("file"), "file", "left_anti").select("file", F.lit(0).cast("long").alias("length"), F.timestamp_seconds(F.lit(0)).alias("modified"))
    return told.unionByName(empty)


def ingest_ndjson(spark: SparkSession, pattern: str, target: str, schema: T.StructType | str | None = None) -> DataFrame:
    """New newline-delimited JSON files (gzip or plain) to Parquet, and all rows ingested so far.

    The decision is made per file and version: what the ledger has with the same length and time of
    change is not read again, so a later call takes what has arrived since, and a file that was
    delivered again under its name replaces its rows. Listing and ledger meet on Spark; the names of
    files to read come back ``FILES_AT_ONCE`` at a time. Lines that do not parse go to a
    quarantine table and are counted; they do not stop the others. Each version of a file is a
    partition of its own and the ledger, which tells the version that counts, is written last, so a
    call that was cut off is repeated without doubling rows. Without a schema it is inferred over all
    rows of a pass. ``target`` holds the folders rows, bad_lines and files.
    """
    ledger = _table(spark, f"{target}/files", _LEDGER).select("file", "length", "modified")
    new = stage(list_files(spark, pattern).join(ledger, ["file", "length", "modified"], "left_anti"), "new-files")
    version = F.md5(F.concat_ws("|", "file", "length", F.unix_micros("modified")))
    new = new.select("*", version.alias("source"), F.md5("file").alias("file_id"))
    left = [r["file"] for r in new.select("file").orderBy("file").limit(FILES_AT_ONCE).collect()]
    while left:
        _ingest(spark, new.where(F.col("file").between(left[0], left[-1])), [unquote(f) for f in left], target, schema)
        left = [r["file"] for r in new.where(F.col("file") > left[-1]).select("file").orderBy("file").limit(FILES_AT_ONCE).collect()]
    if schema is None:
        rows = spark.read.option("mergeSchema", True).parquet(f"{target}/rows")
    else:
        shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        rows = _table(spark, f"{target}/rows", T.StructType([*shape.fields, T.StructField("source", T.StringType())]))
    return rows.join(_table(spark, f"{target}/files", _LEDGER).select("source"), "source", "left_semi").drop("source")


def _ingest(spark: SparkSession, listed: DataFrame, files: list[str], target: str, schema: T.StructType | str | None) -> None:
    """One pass of :func:`ingest_ndjson`."""
    shape = spark.read.json(files).schema if schema is None else schema
    shape = T.StructType.fromDDL(shape) if isinstance(shape, str) else T.StructType([f for f in shape.fields if f.name != "_line"])
    reader = spark.read.schema(T.StructType([*shape.fields, T.StructField("_line", T.StringType())]))
    parsed = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").json(files).withColumn("_file", F.col("_metadata.file_path"))
    parsed = stage(parsed.join(listed.select(F.col("file").alias("_file"), "source"), "_file"), "parsed")
    write_by(parsed.where(F.col("_line").isNull()).drop("_line", "_file"), f"{target}/rows", "source")
    write_by(parsed.where(F.col("_line").isNotNull()).select(F.col("_file").alias("file"), F.col("_line").alias("line"), "source"), f"{target}/bad_lines", "source")
    counts = parsed.groupBy("source").agg(F.count_if(F.col("_line").isNull()).alias("n_rows"), F.count_if(F.col("_line").isNotNull()).alias("n_bad"))
    told = listed.join(counts, "source", "left").fillna(0, ["n_rows", "n_bad"])
    write_by(told.select("file", "length", "modified", "n_rows", "n_bad", "source", "file_id"), f"{target}/files", "file_id")
    unstage(spark, parsed)


def ingested_files(spark: SparkSession, target: str) -> DataFrame:
    """file, n_rows, n_bad of every file that :func:`ingest_ndjson` has taken, in its last version."""
    return _table(spark, f"{target}/files", _LEDGER).select("file", "n_rows", "n_bad")


def bad_lines(spark: SparkSession, target: str) -> DataFrame:
    """file, line of the quarantine of :func:`ingest_ndjson`."""
    current = _table(spark, f"{target}/files", _LEDGER).select("source")
    return _table(spark, f"{target}/bad_lines", _BAD_LINES).join(current, "source", "left_semi").drop("source")


def write_report(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A result table as Parquet, CSV with a header, or JSON lines. Arrays go to CSV as JSON."""
    if kind == "csv":
        nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        df = df.withColumns({n: F.to_json(n) for n in nested})
        df.write.mode("overwrite").option("header", True).csv(path)
    elif kind in ("parquet", "json"):
        df.write.mode("overwrite").format(kind).save(path)
    else:
        raise ValueError(f"unknown report kind {kind!r}")


def write_by(df: DataFrame, path: str, *columns: str, rows_per_file: int | None = 5_000_000) -> None:
    """Hive-partitioned Parquet; partitions in ``df`` replace their old content, others stay.

    Files are cut at ``rows_per_file``. Writing goes through the output committer, so readers never
    see a half-written partition.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)


def export_by_day(df: DataFrame, path: str, ts: str) -> None:
    """One directory per calendar day.

    Rows meet by day before the write to keep the number of files low. The rebalance hint lets
    Spark split a day that is far larger than the others and merge small ones.
    """
    by_day = df.withColumn("day", F.to_date(ts)).hint("rebalance", "day")
    write_by(by_day, path, "day")


def reconcile(source: DataFrame, exported: DataFrame) -> DataFrame:
    """Row totals of source and export and whether they agree."""
    n_source = source.agg(F.count(F.lit(1)).alias("expected"))
    n_out = exported.agg(F.count(F.lit(1)).alias("exported"))
    return n_source.withColumn("exported", n_out.scalar()).withColumn(
        "complete", F.col("expected") == F.col("exported")
    )


def _from_latin1(text: Column) -> Column:
    """Windows-1252 text that was read as ISO-8859-1: the two differ in 0x80 to 0x9F only."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    pairs = [(a, b) for a, b in pairs if b]
    return F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def read_isco_titles(spark: SparkSession, path: str, version: str = "ISCO-08") -> DataFrame:
    """code, title from the Windows-1252 classification structure."""
    raw = spark.read.option("header", True).option("encoding", "iso-8859-1").csv(path)
    return raw.where(F.col("ISCO_version") == version).select(
        F.col("unit").cast("int").alias("code"), F.trim(_from_latin1(F.col("description"))).alias("title")
    )


def read_code_map(spark: SparkSession, path: str) -> DataFrame:
    """mid, code from the two-column code list."""
    return spark.read.option("header", True).csv(path).select(
        F.col("avam").cast("int").alias("mid"), F.col("isco").cast("int").alias("code")
    )


def read_occupation_map(spark: SparkSession, path: str) -> DataFrame:
    """id, name, mid, catalogue from a CSV export of the occupation workbook.

    The columns are taken by position: id, name, code, name of the code, catalogue.
    """
    raw = spark.read.option("header", True).csv(path)
    id_, name, mid, *_, catalogue = raw.columns
    return raw.select(
        F.col(f"`{id_}`").cast("long").alias("id"),
        F.col(f"`{name}`").alias("name"),
        F.col(f"`{mid}`").cast("int").alias("mid"),
        F.col(f"`{catalogue}`").alias("catalogue"),
    )
