"""Best-fit packing of tokenized documents into sequences of fixed capacity, bulk-synchronously.

Documents longer than the capacity are cut, the first piece taking the remainder; every piece is packed
whole.  Pieces are ordered by length, longest first, gaps by size, smallest first.  One superstep takes all
pieces of one length: a successor sweep over the gaps gives the smallest gap that still fits to the first
pieces, the next gap to the next ones, and opens new sequences for the rest.  Which piece meets which gap is
decided by rank: the r-th piece of a length takes the r-th place of the sweep, so no two pieces claim one
gap.  Then the gaps shrink and the next superstep follows.

Lengths and gaps are at most ``capacity`` different numbers, so a superstep is a sweep over runs of equal
gaps: the steps need only the count of pieces of each length (at most ``capacity`` rows, whatever the size
of the corpus), and yield runs of ranks.  Ranks are dealt out where the pieces are: a piece counts within
its partition, and the counts of the partitions before it are added by a join.  No length, however frequent,
meets in one task.

Null and empty texts are one piece that holds the end id.  Repeated rows are packed each for itself.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm import token_ids
from ledgerlens.llm.common import materialize, texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
RUNS = "run_length long, first_rank long, n long, first_sequence long, per_sequence long, first_offset long"


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces; all but the first are full."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Every piece with its length, checksum and its rank among pieces of that length in its partition."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for name, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = token_ids.encode(path, text, end_id)
                for k, (at, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((name, k, at, n, zlib.crc32(ids[at : at + n]), part, int(seen[n])))
                    seen[n] += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
    return texts(docs).mapInArrow(run, PIECES)


def supersteps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, pieces to a sequence, offset of the first) of the packing."""
    runs, sequences = [], 0
    gaps: list[int] = []  # sizes of open gaps, rising
    open_at: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences that have it: first, how many

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in open_at:
                insort(gaps, gap)
                open_at[gap] = []
            open_at[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, rest = 0, counts[length]
        for gap in gaps[bisect_left(gaps, length):]:
            if not rest:
                break
            per, had, kept = gap // length, open_at.pop(gap), []
            gaps.remove(gap)
            for first, n in had:
                taken = min(rest, n * per)
                if not taken:
                    kept.append((first, n))
                    continue
                runs.append((length, rank, taken, first, per, capacity - gap))
                full, part = divmod(taken, per)
                leave(gap - per * length, first, full)
                if part:
                    leave(gap - part * length, first + full, 1)
                used = full + bool(part)
                kept += [(first + used, n - used)] if n > used else []
                rank, rest = rank + taken, rest - taken
            for first, n in kept:
                leave(gap, first, n)
        if rest:
            per = capacity // length
            full, part = divmod(rest, per)
            runs.append((length, rank, rest, sequences, per, 0))
            leave(capacity - per * length, sequences, full)
            if part:
                leave(capacity - part * length, sequences + full, 1)
            sequences += full + bool(part)
    return runs


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    made = materialize(pieces(docs, path, capacity, end_id), "pieces")
    by_part = materialize(made.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    totals = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs = spark.createDataFrame(supersteps(totals, capacity), RUNS)
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    ranked = made.join(before, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("ahead"))
    # the runs are a few for each length up to the capacity: their number doesn't follow the corpus
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first_rank"))
                         & (F.col("rank") < F.col("first_rank") + F.col("n")))
    nth = F.col("rank") - F.col("first_rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"))
