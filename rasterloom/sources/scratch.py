"""Files that a query writes and reads again, in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def folder(spark: SparkSession, label: str) -> str:
    """A new folder's path under spark.checkpoint.dir; only a local session without that setting gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="rasterloom-files-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        named = f"file://{_local[0]}"
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once and read back, for what several later steps read; it survives a lost executor."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, as executors reach it. Spark writes local paths as file:/x."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
