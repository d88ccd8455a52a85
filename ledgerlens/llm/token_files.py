"""Token ids of all documents as files of shards: ids end to end, boundaries in Elias-Fano code.

A shard is one row of a Parquet table, so Spark writes, commits and retries it like any other data and any
store that Spark reaches can hold it:

* ``ids``      the ids of its documents without gaps, little-endian, 2 bytes each where the vocabulary allows, else 4
* ``bounds``   where each document begins and where the last one ends, Elias-Fano (`elias_fano`)
* ``doc_ids``  the rising document ids less ``first_doc``, Elias-Fano; empty where the ids are null

Documents lie in ascending order of doc_id, nulls first; documents of equal ids in the order of their texts.
A null or empty text is the end id alone.  A shard holds whole documents, about ``shard_ids`` ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm import elias_fano, token_ids
from ledgerlens.llm.common import texts

SHARD_IDS = 1 << 20
KEY_CHARS = 64
SHARDS = "part int, shard int, first_doc long, n_docs int, n_ids long, width int, ids binary, bounds binary, doc_ids binary"
SHARD_FIELDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int32()),
                          ("n_ids", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("bounds", pa.binary()),
                          ("doc_ids", pa.binary())])
FOUND = "doc_id long, part int, shard int, nth int, local_start long, n_tokens long, ids_crc32 long"


def ordered(docs: DataFrame) -> DataFrame:
    """Rows in the order of doc_id and text, over all partitions.

    The range is told by the id and how the text begins, so the sample of keys that goes to the driver holds no
    whole texts; rows that agree in both stay together and are sorted there.
    """
    return texts(docs).repartitionByRange("doc_id", F.substring("text", 1, KEY_CHARS)).sortWithinPartitions("doc_id", "text")


def write(docs: DataFrame, path: str, folder: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Encode every document with the tokenizer at ``path`` and write shards below ``folder``."""
    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        width = 2 if token_ids.words(path).small and end_id < 1 << 16 else 4
        held: list[np.ndarray] = []
        names: list[int | None] = []

        def row() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, held)])
            first = names[0]
            own = np.array([n - first for n in names] if first is not None else [], np.uint64)
            ids = np.concatenate(held).astype(f"<u{width}").tobytes()
            return pa.RecordBatch.from_pylist([{
                "part": part, "shard": made, "first_doc": first, "n_docs": len(names), "n_ids": int(ends[-1]), "width": width,
                "ids": ids, "bounds": elias_fano.encode(ends), "doc_ids": elias_fano.encode(own)}], SHARD_FIELDS)

        size = 0
        for batch in batches:
            for name, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if names and (size >= shard_ids or (names[0] is None) != (name is None)):
                    yield row()
                    made, size, held, names = made + 1, 0, [], []
                held.append(token_ids.encode(path, text, end_id))
                names.append(name)
                size += len(held[-1])
        if names:
            yield row()

    ordered(docs).mapInArrow(shards, SHARDS).write.option("compression", "zstd").parquet(folder)


def open_shard(ids: bytes, width: int, bounds: bytes) -> tuple[np.ndarray, elias_fano.Sequence]:
    """Ids of a shard and its boundaries; document i is ids[bounds.select(i):bounds.select(i + 1)]."""
    return np.frombuffer(ids, f"<u{width}"), elias_fano.Sequence(bounds)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document in the files.

    The start of a shard is summed over its part and over the parts before it; of a part only two numbers
    meet in one place, as many rows as the files have parts.
    """
    shards = spark.read.schema(SHARDS).parquet(folder)

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                ids, ends = open_shard(shard["ids"], shard["width"], shard["bounds"])
                ends, n = ends.values().astype(np.int64), shard["n_docs"]
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                if shard["first_doc"] is None:
                    names = pa.nulls(n, pa.int64())
                else:
                    names = pa.array(elias_fano.Sequence(shard["doc_ids"]).values().astype(np.int64) + shard["first_doc"])
                yield pa.RecordBatch.from_arrays([
                    names, pa.array(np.full(n, shard["part"], np.int32)), pa.array(np.full(n, shard["shard"], np.int32)),
                    pa.array(np.arange(n, dtype=np.int32)), pa.array(ends[:-1]), pa.array(np.diff(ends)),
                    pa.array(np.array(crc, np.int64))], ["doc_id", "part", "shard", "nth", "local_start", "n_tokens", "ids_crc32"])

    sizes = shards.select("part", "shard", "first_doc", "n_ids")
    whole = sizes.groupBy("part").agg(F.min("shard").alias("s"), F.min_by("first_doc", "shard").alias("first_doc"), F.sum("n_ids").alias("n_ids"))
    ahead = Window.orderBy(F.col("first_doc").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = whole.select("part", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = (sizes.withColumn("shard_start", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
             .join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("base")))
    return (shards.mapInArrow(found, FOUND).join(bases, ["part", "shard"])
            .select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"))
