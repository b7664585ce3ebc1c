"""Reliable staging of intermediate results and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

# A broadcast side may hold at most this many rows and bytes of Parquet.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20

# Folders made for local sessions that name none.
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can read, named by the cluster in spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="sessionloom-")
        # Staged tables of a local session go with its process.
        atexit.register(shutil.rmtree, _local_folders[app], ignore_errors=True)
    return _local_folders[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write once, read back: cuts lineage and survives the loss of executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Spark's own setting: an execution's shuffle files go with it, not when the driver happens to collect its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_releasing = threading.Lock()


def stage_and_release(df: DataFrame, label: str = "stage") -> DataFrame:
    """`stage`, after which the shuffle files of making it are gone: nothing reads them once the table is written."""
    conf = df.sparkSession.conf
    with _releasing:  # the setting is the session's
        before = conf.get(RELEASE, None)
        conf.set(RELEASE, "true")
        try:
            return stage(df, label)
        finally:
            conf.set(RELEASE, before) if before is not None else conf.unset(RELEASE)


def folder_rows(path: str) -> ds.Dataset:
    """Rows of a folder in the shared folder, read where it is asked for, in a task as well."""
    store = fs.LocalFileSystem()
    if ":" in path.split("/")[0]:
        store, path = fs.FileSystem.from_uri(path)
    return ds.dataset(path, filesystem=store, format="parquet")


def table_bytes(staged: DataFrame) -> int:
    """Size of a staged table's files, from the statistics of its scan."""
    return int(str(staged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(staged: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a staged table when its counted rows and bytes allow it, else leave the join to Spark.

    The count reads Parquet footers only, since the table was staged before.
    """
    if table_bytes(staged) <= size and staged.count() <= rows:
        return F.broadcast(staged)
    return staged
