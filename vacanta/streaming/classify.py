"""Classification of arriving posting files."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vacanta.functions.patterns import Dictionary
from vacanta.operators.match import classify_group, match_keywords
from vacanta.session import tune
from vacanta.sources.staging import stage, unstage


def classify_stream(arriving: DataFrame, dictionary: Dictionary, text: str = "text", language: str = "language") -> DataFrame:
    """Match and classify every arriving posting. Keeps no state and drops nothing."""
    return classify_group(match_keywords(arriving, dictionary, text, language))


def _written(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What earlier batches have written; None before the first."""
    try:
        return spark.read.parquet(path).where(F.col("batch") != batch_id)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def first_copies(arriving: DataFrame, key: str, ts: str) -> DataFrame:
    """Keyed state over arriving postings: for each key and each file touched by a batch, the first copy ever.

    Columns: key (null for a file), file, n (rows of a file), first (since, ts, tie, file, row) and
    last, the time of the newest batch. Time is that of the micro-batch, the same for all its rows and
    when it is repeated: a key is new in a batch if its first copy is as old as its last. State is one
    narrow row per key and per file and lies in the state store; no posting's text is in it, and rows
    without a key have none of their own.
    """
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    since = F.current_timestamp()
    copy = F.struct(since.alias("since"), F.col(ts).alias("ts"), F.xxhash64(*[F.col(c) for c in arriving.columns]).alias("tie"), file.alias("file"), row.alias("row"))
    # Every row counts for its file, and for its key if it has one.
    kept = arriving.select(F.col(key).alias("key"), file.alias("file"), copy.alias("copy"))
    nothing = F.lit(None).cast(arriving.schema[key].dataType)
    told = F.array(F.struct(nothing.alias("key"), F.col("file").alias("file")), F.struct(F.col("key").alias("key"), F.lit(None).cast("string").alias("file")))
    each = kept.select(F.explode(told).alias("of"), "copy").where("of.key IS NOT NULL OR of.file IS NOT NULL")
    return each.groupBy(F.col("of.key").alias("key"), F.col("of.file").alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.min("copy").alias("first"), F.max("copy.since").alias("last")
    )


def run_available(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    dictionary: Dictionary,
    key: str,
    ts: str,
    delay: str = "30 days",
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Process all files not seen yet and stop; call again for the next ones.

    The rule of the batch job holds: of postings with one key the first stays, postings without a
    key all stay. A batch keeps the first of its copies and drops those whose key an earlier batch had,
    whatever their age, so nothing depends on a watermark and no posting is lost. Keys are kept by
    :func:`first_copies` in a state store on disk, so a batch costs what it holds and not what was ever
    written. The batch's wide rows are read again from its own files, by file and row number, once it is
    known which of them stay. Target and report are partitioned by batch and a repeated batch, which
    finds the state it had before, replaces its own partition.

    ``{target}-report`` tells per batch: n_read = n_written + n_duplicates + n_late, where n_late
    are the written postings that lie more than ``delay`` before the newest one of earlier batches.
    """
    tune(spark)
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    report = f"{target}-report"

    def process(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        fresh_keys = stage(batch.where(F.col("first.since") == F.col("last")), "arrived")
        # At most files_per_batch.
        files = [unquote(r["file"]) for r in fresh_keys.where("file IS NOT NULL").select("file").collect()]
        if not files:
            return
        read = session.read.schema(schema).parquet(*files)
        wide = read.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        winners = fresh_keys.where("key IS NOT NULL").select(F.col("first.file").alias("_file"), F.col("first.row").alias("_row"))
        keyed = wide.where(F.col(key).isNotNull()).join(winners, ["_file", "_row"], "left_semi")
        fresh = keyed.unionByName(wide.where(F.col(key).isNull())).drop("_file", "_row")
        told = _written(session, report, batch_id)
        newest = None if told is None else told.agg(F.max("newest")).first()[0]
        late = F.lit(False) if newest is None else F.coalesce(F.col(ts) < F.lit(newest) - F.expr(f"INTERVAL {delay}"), F.lit(False))
        out = classify_stream(fresh, dictionary).drop("matches")
        out.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        written = session.read.parquet(f"{target}/batch={batch_id}").agg(F.count(F.lit(1)).alias("n"), F.count_if(late).alias("n_late"))
        n_read = fresh_keys.where("file IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_read"))
        counts = n_read.withColumns({"newest": read.agg(F.max(ts)).scalar(), "n": written.select("n").scalar(), "n_late": written.select("n_late").scalar()})
        counts.select(
            "n_read", (F.col("n") - F.col("n_late")).alias("n_written"), (F.col("n_read") - F.col("n")).alias("n_duplicates"), "n_late", "newest"
        ).write.mode("overwrite").parquet(f"{report}/batch={batch_id}")
        unstage(session, fresh_keys)

    keyed = first_copies(arriving, key, ts)
    return keyed.writeStream.outputMode("update").foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
