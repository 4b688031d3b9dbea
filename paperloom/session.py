"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import paperloom

# Functions travel to the executors by value: they need no copy of this package there.
cloudpickle.register_pickle_by_value(paperloom)

_LOCAL = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Texts are long: small batches keep the Arrow hop to tens of megabytes per task.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def local_session(app: str = "paperloom", cores: int | None = None) -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own."""
    cores = cores or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.files.maxPartitionBytes", "128m")
    )
    for key, value in _LOCAL.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the one setting results depend on; all others stay with the session's owner."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it.

    Only a local session may fall back to a folder of this machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="paperloom-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Seconds that a copy took to be worth looking for the shuffle files it left.
LONG_COPY_S = 2.0


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that ended. It does so when the driver's JVM collects
    garbage, which a driver with memory to spare puts off while the disks of the executors fill up."""
    spark._jvm.java.lang.System.gc()


def cut_lineage(df, label: str):
    """Write ``df`` to the shared folder and read it back: survives lost executors."""
    spark = df.sparkSession
    path, began = scratch_path(spark, label), time.monotonic()
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    if time.monotonic() - began > LONG_COPY_S:
        free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def stored_copy(df, label: str, by=(), codec: str = "zstd"):
    """``cut_lineage`` for the length of a block; the copy stays behind when the block fails."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").option("compression", codec).partitionBy(*by).parquet(path)
    yield spark.read.schema(df.schema).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
