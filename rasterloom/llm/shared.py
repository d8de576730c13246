"""Tables that one step writes and later steps read, in the folder that the whole cluster shares.

A written table cuts lineage and survives a lost executor. The folder is named by spark.checkpoint.dir; only a local
session without that setting gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The shared folder. Raises on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _local:
        _local[key] = tempfile.mkdtemp(prefix="rasterloom-")
        atexit.register(shutil.rmtree, _local[key], ignore_errors=True)
    return "file://" + _local[key]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def write(df: DataFrame, label: str) -> DataFrame:
    """Write df once and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rasterloom_path = path  # for drop()
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables made by write() that no later step reads."""
    for df in tables:
        path, spark = df._rasterloom_path, df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, size: str = "4m", rows: int = 2000) -> None:
    """Bound what one Arrow transfer holds on either side; the default of 64 MB a batch is meant for larger executors."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
