"""Intermediate tables: where they go, and when they go away."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; only a local session without one (a test) gets its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read back: lineage ends there, and a lost executor costs no rework before it."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        _written.remove(p)


def discard(*tables: DataFrame) -> None:
    """Removes tables that cut has written and that nothing reads any more."""
    _remove(tables[0].sparkSession, [t._cut for t in tables])


def clean(spark: SparkSession) -> int:
    """Removes all tables that cut has written so far, and says how many; for when the results made from them are stored."""
    paths = list(_written)
    _remove(spark, paths)
    return len(paths)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished jobs now: it does so when the driver's JVM has collected what refers to them."""
    spark.sparkContext._jvm.System.gc()
