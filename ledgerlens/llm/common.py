"""What the operators share: input columns, blocks of documents, stored intermediates."""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.runtime import materialize, shared_dir

__all__ = ["blocks", "documents", "importable", "materialize", "shared_dir", "text_bytes", "texts", "whole"]

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Settings of Python workers: Arrow takes memory from the C library, which maps buffers from 4 MiB on by themselves.
RETURN_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "16777216",
                 "MALLOC_ARENA_MAX": "2"}
#: Bytes of one Arrow batch to a Python worker, unless the session was started with a size of its own.
BATCH_SIZE = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def importable() -> None:
    """Python workers started from now on look for this package where the driver found it.

    On a cluster the package is installed or comes with --py-files; a local session need not be started in
    the repository's folder.  Workers live on from stage to stage, so their buffers go back to the system as
    soon as they are free, and batches of long texts are bounded by bytes, not only by rows.
    """
    spark = SparkSession.active()
    if spark.sparkContext.getConf().get(BATCH_SIZE[0]) is None:
        spark.conf.set(*BATCH_SIZE)
    env = spark.sparkContext.environment
    for name, value in RETURN_MEMORY.items():
        env.setdefault(name, value)
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (path, ROOT) if x)


def whole(text: str = "text") -> Column:
    """The whole text, empty where it is null."""
    return F.coalesce(F.col(text), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and whole text (null: empty) alone, so that no other column can clash or travel."""
    importable()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"), *more)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one number, from which numbers of blocks follow."""
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """texts(docs) with a column ``block``: documents dealt at random into blocks of about ``block_bytes``.

    The block follows from the row's content, so a recomputed task deals alike, and rows that share an id
    or have none still spread by their text.
    """
    n = max(1, math.ceil(text_bytes(docs) / block_bytes))
    return texts(docs).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
