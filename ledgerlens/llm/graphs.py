"""Connected components of links, and membership tests that need no shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import importable, materialize

SLICE = 1 << 18
SLICES = 256
MIX = np.uint64(0x9E3779B97F4A7C15)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): the smallest node that it reaches; roots map to themselves.

    Stars are grown by turns (each node's larger neighbours to its smallest, then its smaller ones) until
    nothing moves.  Each turn is written to the shared folder, so lineage stays short and a lost executor
    costs one turn at most.  Nothing but a checksum of the links comes to the driver.
    """
    def seal(df: DataFrame) -> tuple[DataFrame, tuple]:
        kept = materialize(df.where(F.col("u") != F.col("v")).distinct(), "stars")
        return kept, tuple(kept.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges, sign = seal(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while sign[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(low.select("u", F.col("m").alias("v")))
        edges, now = seal(small)
        if now == sign:
            break
        sign = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _places(ids: np.ndarray) -> list[np.ndarray]:
    h = ids.astype(np.int64).view(np.uint64) * MIX
    h ^= h >> np.uint64(31)
    h *= MIX
    bits = np.uint64(64 - (SLICE * SLICES).bit_length() + 1)
    return [(h >> bits).astype(np.int64), ((h * MIX) >> bits).astype(np.int64)]


class Sieve:
    """Bits of fixed size (8 MiB) that are set for every id of a table and few others."""

    def __init__(self, ids: DataFrame):
        importable()

        def marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = np.unique(np.concatenate(_places(batch[0].to_numpy(zero_copy_only=False))))
                yield pa.RecordBatch.from_arrays([pa.array((place // SLICE).astype(np.int32)), pa.array((place % SLICE).astype(np.int32))],
                                                 ["slice", "bit"])

        def gather(rows: pa.Table) -> pa.Table:
            bits = np.zeros(SLICE, np.uint8)
            bits[rows["bit"].to_numpy()] = 1
            return pa.table({"slice": rows["slice"][:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

        set_bits = ids.toDF("id").where("id is not null").mapInArrow(marks, "slice int, bit int").distinct()
        self.bits = np.zeros(SLICE * SLICES // 8, np.uint8)
        for row in set_bits.groupBy("slice").applyInArrow(gather, "slice int, bits binary").collect():  # at most SLICES rows
            self.bits[row.slice * SLICE // 8 : (row.slice + 1) * SLICE // 8] = np.frombuffer(row.bits, np.uint8)

    def may_hold(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), bool)
        for place in _places(ids):
            out &= (self.bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
        return out
