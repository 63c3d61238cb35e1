"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Only a local master, whose tasks all see one disk, may go without it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
        found = "file:///tmp/checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """For actions that run inside: each one's shuffle files go as it ends, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and losing executors loses nothing.

    The table goes when the driver's JVM ends, or with `drop_stored` or `clear_stored`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/skyfold-{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    p, fs = _at(spark, path)
    fs.deleteOnExit(p)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def drop_stored(*frames: DataFrame) -> None:
    """Deletes the tables behind frames that `stored` returned.  For when what reads them has been stored in turn."""
    for df in frames:
        p, fs = _at(df.sparkSession, _PATHS.pop(df))
        fs.delete(p, True)


def only_result(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """run returns a frame of `stored`; the other tables that are written meanwhile, for it alone, go as it returns."""

    @wraps(run)
    def wrapped(*args, **more) -> DataFrame:
        before = len(_WRITTEN)
        out = run(*args, **more)
        for path in _WRITTEN[before:]:
            if path != _PATHS[out]:
                p, fs = _at(out.sparkSession, path)
                fs.delete(p, True)
        return out

    return wrapped


def clear_stored(spark: SparkSession) -> None:
    """Deletes the tables that `stored` has written so far.  For when the results that read them have been taken."""
    while _WRITTEN:
        p, fs = _at(spark, _WRITTEN.pop())
        fs.delete(p, True)
