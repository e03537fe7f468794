"""Cutting lineage in the shared folder of spark.checkpoint.dir, so that lost executors cost no recomputation."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the checkpoint folder.

    The folder comes from spark.checkpoint.dir. A session on this machine alone (tests) gets one of its own where that is
    unset; on a cluster a machine-local folder would be lost with its machine, so the setting is required there.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The same rows, written once as Parquet beside the checkpoints: smaller than a checkpoint, and read by column."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def release(*what: DataFrame | str) -> None:
    """Deletes written tables and folders that no later work reads, and lets Spark remove shuffles that nothing refers to.

    Spark removes a shuffle's files when the driver's JVM collects the plan that made it, which may be long after its last use.
    """
    spark = SparkSession.getActiveSession()
    for x in what:
        for path in [x] if isinstance(x, str) else {f.rsplit("/", 1)[0] for f in x.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()  # Python objects that only a cycle keeps would keep their plans
    time.sleep(3)  # a thread of its own tells the JVM which ones are gone
    spark.range(1).groupBy("id").count().collect()  # Spark holds what ran last until something else has run
    spark._jvm.java.lang.System.gc()
