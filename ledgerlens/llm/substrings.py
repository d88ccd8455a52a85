"""Removal of passages that repeat within and across documents, by content-defined chunking.

A gear rolling hash over the last ``WINDOW`` bytes cuts a text wherever its top ``CUT_BITS`` bits are zero,
so cuts depend on nothing but the bytes just before them and move along with insertions.  From every cut a
variable chunk runs to the first cut at least ``least`` bytes on; chunks overlap, and a repeated passage
consists of the same chunks wherever it stands, but for the first cut and the last.  Chunks are told apart
by digest.  Of equal chunks the first stays: that of the smallest doc_id (null last), then by place; the
bytes of all others go, so what goes is always part of a string of at least ``least`` bytes that stays
elsewhere.  Where something went between two rests a blank stands in, unless there is white space already.

Chunks meet by digest in buckets, each block of documents naming a chunk once (`exchange`); a passage in a
third of all documents is one entry per block.

Null texts stay null; texts shorter than ``least`` bytes stay as they are.  Rows that share a doc_id are told
apart by their place in the block.  Digests have 64 bits.
"""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import importable, text_bytes
from ledgerlens.llm.exchange import ask

LEAST = 128
WINDOW = 16
CUT_BITS = 4
#: A worker holds about ten times its block: bytes, chunks and their digests in several orders.
BLOCK_BYTES = 4_000_000
BUCKET_BYTES = 16_000_000
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
LAST_ID = (1 << 63) - 1
#: A random 16-bit number for each byte.
GEAR = np.array([xxhash.xxh3_64_intdigest(bytes([b])) >> 48 for b in range(256)], np.uint16)


def cuts(data: bytes) -> np.ndarray:
    """Rising places of the cuts, with the beginning and the end of the text.

    Doubling adds up the hash of 2, 4, 8 and 16 bytes: h(i) = sum of gear(byte i - j) << j.
    """
    h = GEAR[np.frombuffer(data, np.uint8)]
    span = 1
    while span < WINDOW:
        wider = h.copy()
        wider[span:] += h[:-span] << np.uint16(span)
        h, span = wider, 2 * span
    inner = np.flatnonzero(h[WINDOW - 1 : -1] >> np.uint16(16 - CUT_BITS) == 0) + WINDOW
    return np.concatenate([[0], inner, [len(data)]])


def chunks(data: bytes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and digests of the overlapping chunks of a text."""
    if len(data) < least:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint64)
    at = cuts(data)
    ends = np.searchsorted(at, at + least)
    whole = ends < len(at)
    starts, ends = at[whole].astype(np.int32), at[ends[whole]].astype(np.int32)
    digest = xxhash.xxh3_64_intdigest
    each = (digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    return starts, ends, np.fromiter(each, np.uint64, len(starts))


def block_chunks(texts: list[str | None], least: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts of a block; text, start, end and digest of each chunk."""
    data = [(t or "").encode() for t in texts]
    found = [chunks(d, least) for d in data]
    of = np.repeat(np.arange(len(data), dtype=np.int32), [len(x[2]) for x in found])
    return (data, of, *(np.concatenate([x[k] for x in found]) for k in range(3)))


def rest(data: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, a blank in their place where two words would meet."""
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a].decode())
        at = b
    out.append(data[at:].decode())
    kept = [x for x in out if x]
    for k, (x, y) in enumerate(pairwise(kept)):
        if not x[-1].isspace() and not y[0].isspace():
            kept[k] = x + " "
    return "".join(kept)


def united(data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The spans that the chunks cover, drawn in to whole characters."""
    out: list[tuple[int, int]] = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):  # both rise
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    whole = []
    for a, b in out:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            whole.append((a, b))
    return whole


def deduplicate(docs: DataFrame, least: int = LEAST, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with the rest as text, and ``removed_spans``: start and end in UTF-8 bytes.

    A column of ``docs`` named removed_spans is replaced.
    """
    importable()
    docs = docs.drop("removed_spans")
    total = text_bytes(docs)
    n_blocks, n_buckets = max(1, math.ceil(total / block_bytes)), max(1, math.ceil(total / bucket_bytes))
    block = "block"
    while block in docs.columns:
        block = "_" + block
    names = [F.xxhash64(F.col("doc_id").cast("long"), "text")]
    blocked = docs.withColumn(block, F.pmod(*names, F.lit(n_blocks)).cast("int"))
    fields = T.StructType([*docs.schema.fields, T.StructField("removed_spans", SPANS)])

    def ordered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's rows (null: last) and their order, rows of equal id by their text."""
        ids = rows["doc_id"].cast(pa.int64()).fill_null(LAST_ID).to_numpy()
        return ids, np.array(sorted(range(len(ids)), key=lambda i: (ids[i], rows["text"][i].as_py() or "")), np.int64) \
            if len(np.unique(ids)) < len(ids) else np.argsort(ids, kind="stable")

    def firsts(rows: pa.Table):
        """Chunks of a block in the order of ids; their distinct digests, and which chunk has each first."""
        ids, order = ordered(rows)
        texts = rows["text"].take(pa.array(order)).to_pylist()
        data, of, starts, ends, digest = block_chunks(texts, least)
        keys, first, key = np.unique(digest, return_index=True, return_inverse=True)
        return ids, order, data, of, starts, ends, keys, first, key

    def keys_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, order, _, of, _, _, keys, first, _ = firsts(rows)
        return keys, ids[order][of[first]]

    def decide(keys: np.ndarray, ids: np.ndarray, owners: np.ndarray) -> np.ndarray:
        order = np.lexsort((owners, ids, keys))
        sorted_keys = keys[order]
        new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
        out = np.zeros(len(keys), np.uint8)
        out[order[new]] = 1
        return out

    def finish(rows: pa.Table, stays: np.ndarray) -> pa.Table:
        _, order, data, of, starts, ends, keys, first, key = firsts(rows)
        goes = np.ones(len(of), bool)
        goes[first[stays == 1]] = False
        texts, spans = rows["text"].to_pylist(), [[] for _ in range(len(rows))]
        at = np.flatnonzero(goes)
        for k in np.unique(of[at]):
            own = at[np.searchsorted(of[at], k) : np.searchsorted(of[at], k, "right")]
            cut = united(data[k], starts[own], ends[own])
            if cut:
                texts[order[k]] = rest(data[k], cut)
                spans[order[k]] = [{"start": a, "end": b} for a, b in cut]
        out = rows.drop_columns([block])
        out = out.set_column(out.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        return out.append_column("removed_spans", pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))

    return ask(blocked, block, n_buckets, keys_of, "<i8", decide, "u1", finish, fields)
