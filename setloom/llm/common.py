"""Shared helpers: table access, intermediate tables in the shared folder, worker-side caches."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    One of our own only where it is unset and the session is local, with driver and executors in one
    process; on a cluster that would be a folder of the driver's alone, so that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = where.get() if where.isDefined() else None
    if not where:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="setloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and return a DataFrame that reads it.

    This cuts lineage: losing an executor afterwards costs a re-read, never a recomputation. The
    files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/setloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that stored() wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in {os.path.dirname(f) for f in df.inputFiles()}:
            if "/setloom-" in file:
                target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
                target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the shuffle files of queries that nothing refers to any more, as it does after any collection of the driver's heap."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tokenizer_file(name: str) -> str:
    """A vocabulary file: an absolute path as it is, another name from the installed public tokenizers."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
