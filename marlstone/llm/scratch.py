"""Materialised intermediates in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
#: Paths of this application's intermediates in the order in which they were made.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset: one of our own if all runs in one JVM (tests), else an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="marlstone-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def _root(spark: SparkSession) -> str:
    """This application's own folder there, which goes when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{shared_dir(spark)}/marlstone-{app}-{uuid.uuid4().hex[:8]}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_ROOTS[app])
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
    return _ROOTS[app]


def stash(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", codec).parquet(path)
    _MADE.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for x in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _MADE.remove(x)


def drop(*frames: DataFrame) -> None:
    """Delete stashed frames whose last reader is done."""
    for df in frames:
        if (path := getattr(df, "_scratch", None)) in _MADE:
            _delete(df.sparkSession, [path])


def mark() -> int:
    return len(_MADE)


def drop_since(spark: SparkSession, at: int, keep: DataFrame) -> None:
    """Delete what was stashed after mark() gave `at`, but for `keep`."""
    _delete(spark, [x for x in _MADE[at:] if x != getattr(keep, "_scratch", None)])
