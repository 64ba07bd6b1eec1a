"""Tables written mid-job so that a later stage neither recomputes nor keeps long lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_dir(spark: SparkSession) -> str:
    """Shared folder of the session for staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting
    gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        # local-cluster has executors of its own; only a session in one process may choose a folder.
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="vacanta-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return f"{configured}/vacanta-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back.

    Unlike a cached block it outlives any executor, and its true size is known to the optimizer.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(spark: SparkSession, *staged: DataFrame) -> None:
    """Remove staged tables that no one reads any more, such as wide ones at the end of a job."""
    base = staging_dir(spark)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for df in staged:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if base.split(":")[-1].rstrip("/") not in folder:
                raise ValueError(f"not a staged table: {folder}")
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
