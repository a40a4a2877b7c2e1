"""Cutting lineage through tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_own_folders: dict[str, str] = {}
#: Spark drops a query's shuffle files when it ends, instead of when the driver's garbage is collected.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """Folder named by the cluster in ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a session whose driver and
    tasks are one process (``local[n]``); on a cluster that is an error, since
    executors would write to disks that the others cannot see.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that driver and executors share (master {master})")
        # a running session does not take the setting any more, so the folder is remembered here
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        folder = _own_folders[app]
    return folder.rstrip("/")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries run inside go as each query ends."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)


def write_table(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet; its shuffle files go as soon as it is written."""
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)


#: Tables of the scopes that are open in this thread, innermost last.
_scopes: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("scopes", default=())


@contextmanager
def temporary_tables(keep_last: bool = False) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are removed at the end.

    ``keep_last`` leaves the last of them, for a result that is built on it;
    it then belongs to the scope around, if there is one.
    """
    mine: list[tuple[SparkSession, str]] = []
    around = _scopes.get()
    token = _scopes.set((*around, mine))
    try:
        yield
    finally:
        _scopes.reset(token)
        if keep_last and mine:
            kept = mine.pop()
            if around:
                around[-1].append(kept)
        for spark, path in mine:
            remove_table(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back as a leaf of later plans.

    Unlike a cached or checkpointed RDD the stored table keeps column pruning
    and filter pushdown, and it outlives lost executors.  Inside
    ``temporary_tables`` it goes with the scope; outside it stays, since the
    result that reads it is lazy.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tickloom-{name}-{uuid.uuid4().hex}"
    write_table(df, path)
    if _scopes.get():
        _scopes.get()[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a table whose readers are through."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
