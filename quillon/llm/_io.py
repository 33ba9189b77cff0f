"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Bytes that a batch between the JVM and Python holds while a job of ours writes; rows may be large here.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only where it is unset and all runs on one machine, as in tests."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quillon-{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_BYTES for the jobs inside; the session's own setting comes back after them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def saved(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """df written to the shared folder and read again: short lineage that outlives executors.

    The rows of a narrow frame (ids, pairs, labels) are first dealt out anew, so that few
    files hold them while what made them keeps its tasks.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with small_batches(spark):
        (df.hint("rebalance") if narrow else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete what saved() wrote; the frames must not be used afterwards."""
    for df in frames:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            if "/quillon-" in path:
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
