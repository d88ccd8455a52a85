"""Quartile bucket digests: short fingerprints whose difference tells how alike two texts are.

Six triplets of the bytes in a sliding window of five are hashed into 256 buckets.  Each bucket is written
as the quartile that its count falls into (two bits), behind a byte for the logarithm of the length:

    fingerprint = 2 hex digits of length, 128 hex digits of quartiles

The difference of two digests adds up the steps between the quartiles of each bucket (a jump over all four
counts double) and the distance of the lengths, at most ``WORST``; likeness is 1 less its share of that.

A null text is empty.  Texts too short for a triplet have all buckets in the lowest quartile; equal texts
have equal fingerprints.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import materialize, texts

BUCKETS = 256
WINDOW = 5
#: Places in the window, the newest byte always among them, and a salt for each.
TRIPLETS = ((0, 1, 2, 3), (0, 1, 3, 5), (0, 2, 3, 7), (0, 2, 4, 11), (0, 1, 4, 13), (0, 3, 4, 17))
LENGTH_STEPS = 16
STEP_COST = np.array([0, 1, 2, 6])
WORST = 6 * BUCKETS + LENGTH_STEPS
#: Characters of a text in the key of a range: no whole texts in Spark's sample of keys.
KEY_CHARS = 64
EDGES = [("part", pa.int32()), ("is_last", pa.bool_()), ("text", pa.string())]
FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
          ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NOTHING = (None,) * (len(FIELDS) - 1)
PART = 1 << 16


def bucket_counts(data: bytes) -> np.ndarray:
    """How many triplets fall into each bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    every = np.frombuffer(data, np.uint8)
    for at in range(0, max(0, len(every) - WINDOW + 1), PART):  # stretches that stay in the processor's cache
        b = every[at : at + PART + WINDOW - 1].astype(np.uint32)
        n = len(b) - WINDOW + 1
        newest = b[WINDOW - 1 :]
        for _, i, j, salt in TRIPLETS:
            code = newest | b[WINDOW - 1 - i : WINDOW - 1 - i + n] << 8 | b[WINDOW - 1 - j : WINDOW - 1 - j + n] << 16
            code += np.uint32(salt << 24)
            code *= np.uint32(0x9E3779B1)
            counts += np.bincount((code >> 24).astype(np.intp), minlength=BUCKETS)
    return counts


class Digest:
    """Quartile of each bucket, and the step of the length."""

    __slots__ = ("quartiles", "length")

    def __init__(self, text: str):
        data = text.encode()
        counts = bucket_counts(data)
        ordered = np.sort(counts)
        bounds = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
        self.quartiles = np.searchsorted(bounds, counts, side="left").astype(np.int64)
        self.length = min(255, round(8 * math.log2(1 + len(data))))

    def __str__(self) -> str:
        bits = self.quartiles.reshape(-1, 4) @ np.array([64, 16, 4, 1])
        return f"{self.length:02x}" + bits.astype(np.uint8).tobytes().hex()

    def difference(self, other: Digest) -> int:
        return int(STEP_COST[np.abs(self.quartiles - other.quartiles)].sum()) + min(LENGTH_STEPS, abs(self.length - other.length))

    def likeness(self, other: Digest) -> float:
        return 1.0 - self.difference(other) / WORST


def edited(text: str, after: str) -> str:
    """The text with its second half (rounded down) replaced by as much of the beginning of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def in_ranges(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """texts(docs) in ranges of descending doc_id (nulls last), rows of one id by text; sorted within each range.

    Many rows of one id or of none part by their first characters.
    """
    rows = texts(docs)
    keys = [F.col("doc_id").desc_nulls_last(), F.substring("text", 1, KEY_CHARS)]
    dealt = rows.repartitionByRange(ranges, *keys) if ranges else rows.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "text")


def with_next(name: int | None, text: str, own: Digest, after: str, after_own: Digest) -> tuple:
    changed = edited(text, after)
    other = Digest(changed) if changed != text else own
    return (name, len(text), hashlib.sha256(changed.encode()).hexdigest(), str(own), str(other), own.likeness(other), own.likeness(after_own))


def batch_of(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def fingerprint_edits(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edit with the next one, in descending order of doc_id.

    Each range is one sweep.  Its last document needs the first one of the next range, so both leave the sweep as
    they are, two rows for each range, and are joined by the range's number.  What the sweeps give is stored
    (a job runs while this frame is built); the number of ranges is the session's number of shuffle partitions
    unless it is given.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple[int | None, str, Digest] | None = None
        for batch in batches:
            rows: list[tuple] = []
            for name, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = Digest(text)
                if held is None:
                    rows.append((part, False, text, name, *NOTHING))
                else:
                    rows.append((None, None, None, *with_next(*held, text, own)))
                held = (name, text, own)
            if rows:
                yield batch_of(rows, EDGES + FIELDS)
        if held:
            yield batch_of([(part, True, held[1], held[0], *NOTHING)], EDGES + FIELDS)

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "after")), strict=True)
            found = [with_next(name, text, Digest(text), after, Digest(after)) for name, text, after in rows]
            if found:
                yield batch_of(found, FIELDS)

    swept = materialize(in_ranges(docs, ranges).mapInArrow(run, f"part int, is_last boolean, text string, {ROWS}"), "digests")
    names = [n for n, _ in FIELDS]
    firsts = swept.where("not is_last").select("part", "text")
    # numbers of ranges that hold a document, each with the next of them, after the last the first
    order = Window.orderBy("part")
    lowest = F.min("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = firsts.select("part").select(F.col("part").alias("own"), F.coalesce(F.lead("part").over(order), lowest).alias("next"))
    lasts = swept.where("is_last").select(F.col("part").alias("own"), "doc_id", "text")
    met = lasts.join(following, "own").join(firsts.select(F.col("part").alias("next"), F.col("text").alias("after")), "next")
    return swept.where("part is null").select(*names).unionByName(met.select("doc_id", "text", "after").mapInArrow(close, ROWS))
