"""Session helpers: settings the jobs expect, shared work folders, stored intermediates."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerlens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


@functools.cache
def _own_folder() -> str:
    """One scratch folder per local process, gone when the process ends."""
    folder = tempfile.TemporaryDirectory(prefix="ledgerlens-", ignore_cleanup_errors=True)
    _FOLDERS.append(folder)
    return folder.name


_FOLDERS: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared checkpoint folder of the session.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only a local
    master may fall back to a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = _own_folder()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate below the shared folder and read it back.

    For a small result that several branches of one query need: it is computed
    once, and a lost executor recomputes from the stored files.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
