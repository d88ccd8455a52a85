"""Counting many parts of a text in one sweep: rolling hashes by part length, hits confirmed by digest.

What travels to a document is its parts' lengths, hashes and digests, never their texts.  The document's prefix
sums of ``c * BASE**place`` give the hash of every window of one length by a subtraction, so all parts of that
length are looked up at once; a window is a hit only if its SHA-256 is that of the part.  Where the first
characters of a part are known too, all parts are first looked for by these, in one pass, and windows are hashed
only if many places are left.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Collection, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIME = (1 << 31) - 1
BASE = 1_103_515_245
#: Parts that one reading of a document looks for; a document with more of them is read once for each so many.
PARTS = 10_000
#: Code points by which parts are first looked for.
HEAD = 32
#: Places of a head up to which windows are confirmed by digest at once.
FEW = 16
_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def _fold(values: np.ndarray) -> np.ndarray:
    """The same modulo PRIME, which is 2**31 - 1, and far smaller; without a division."""
    return (values & np.uint64(PRIME)) + (values >> np.uint64(31))


def _rest(values: np.ndarray) -> np.ndarray:
    """Values below 2**63 modulo PRIME."""
    values = _fold(_fold(values))
    return np.minimum(values, values - np.uint64(PRIME))  # below PRIME the difference wraps round and is the larger


_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    """BASE**0 to BASE**n modulo PRIME, by doubling; kept for the next text."""
    out = _POWERS[0]
    while len(out) <= n:
        out = np.concatenate([out, _rest(out * np.uint64(pow(BASE, len(out), PRIME)))])
    _POWERS[0] = out
    return out[: n + 1]


def mark(text: str) -> int:
    if not text:
        return 0
    codes = _codes(text)
    # products are below 2**52, so that 4096 of them can be summed
    return sum(np.add.reduceat(codes * _powers(len(codes))[:-1], np.arange(0, len(codes), 4096)).tolist()) % PRIME


def _heads(codes: np.ndarray) -> np.ndarray:
    """A number for each HEAD code points in a row, by doubling their count."""
    for k, odd in enumerate(_MIX):
        codes = codes[: -(1 << k)] * np.uint64(odd) + codes[1 << k :]
    return codes.view(np.int64)


#: What the doublings multiply each code point by.
_WEIGHTS = np.array([math.prod(odd for k, odd in enumerate(_MIX) if not i >> k & 1) % (1 << 64) for i in range(HEAD)], np.uint64)


def head(text: str) -> int | None:
    """The number of the first HEAD code points; a shorter text has none."""
    return int((_codes(text[:HEAD]) * _WEIGHTS).sum().view(np.int64)) if len(text) >= HEAD else None


def _places(hashes: np.ndarray, wanted: Collection[int]) -> list[tuple[int, int]]:
    """Place and hash where one of those wanted stands, ascending."""
    values = np.array(list(wanted), hashes.dtype)
    found = np.flatnonzero(hashes == values[0] if len(values) == 1 else np.isin(hashes, values))
    return list(zip(found.tolist(), hashes[found].tolist(), strict=True))


def count_parts(text: str, parts: Iterable[tuple[int, int, str]], heads: Iterable[int | None] | None = None) -> list[int]:
    """How often each part (length, mark, SHA-256 in hex) stands in the text, left to right without overlap.

    ``heads`` are the parts' heads, if known.
    """
    parts = list(parts)
    codes = _codes(text)
    n = len(codes)
    groups: dict[tuple[int, int | None], list[int]] = {}
    for k, (known, (length, _, _)) in enumerate(zip(heads or [None] * len(parts), parts, strict=True)):
        if 0 < length <= n:
            groups.setdefault((length, known), []).append(k)
    starts: dict[int, list[int]] = {known: [] for _, known in groups if known is not None}
    for i, known in _places(_heads(codes), starts) if starts else ():
        starts[known].append(i)
    sums = powers = None
    times = [0] * len(parts)
    for (length, known), ks in groups.items():
        places = None if known is None else starts[known][: bisect.bisect_right(starts[known], n - length)]
        if places is not None and len(places) <= FEW:
            hits = [(i, ks) for i in places]
        else:
            if sums is None:
                powers = _powers(n)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_fold(codes * powers[:-1]), dtype=np.uint64)])
            wanted: dict[int, list[int]] = {}
            for k in ks:
                wanted.setdefault(parts[k][1] * int(powers[n]) % PRIME, []).append(k)
            # windows raised to the same power, so that equal texts have equal hashes wherever they stand
            if places is None:
                hashes = _rest(_fold(sums[length:] - sums[:-length]) * powers[n : length - 1 : -1])
                hits = [(i, wanted[h]) for i, h in _places(hashes, wanted)]
            else:
                at = np.array(places)
                hashes = _rest(_fold(sums[at + length] - sums[at]) * powers[n - at])
                hits = [(places[j], wanted[h]) for j, h in _places(hashes, wanted)]
        free = dict.fromkeys(ks, 0)
        for i, same in hits:
            asked = [k for k in same if i >= free[k]]
            if asked:
                digest = hashlib.sha256(text[i : i + length].encode()).hexdigest()
                for k in asked:
                    if parts[k][2] == digest:
                        times[k] += 1
                        free[k] = i + length
    return times


@F.pandas_udf(T.StructType([T.StructField("mark", T.LongType()), T.StructField("head", T.LongType())]))
def _marks(parts: pd.Series) -> pd.DataFrame:
    shown = parts.fillna("")
    return pd.DataFrame({"mark": pd.array([mark(p) for p in shown], "Int64"), "head": pd.array([head(p) for p in shown], "Int64")})


@F.pandas_udf(T.ArrayType(T.LongType()))
def _times(texts: pd.Series, parts: pd.Series) -> pd.Series:
    found = [count_parts(t, [(p["length"], p["mark"], p["sha"]) for p in ps], [p["head"] for p in ps]) for t, ps in zip(texts, parts, strict=True)]
    return pd.Series(found, dtype="object")


def counted(documents: DataFrame, sources: DataFrame, keys: Sequence[str], text: str, part: str, at_most: int = PARTS, carry: Sequence[str] | None = None) -> DataFrame:
    """``sources`` with times: how often each part stands in each document of its keys, without overlap.

    Sources without a document, empty or null parts and null texts give no row.  Equal parts of a document are looked for
    once; documents that share their keys are counted each by itself.  Texts stay where their documents and sources are
    read: marks and counts are what is exchanged, and only the few documents with more than ``at_most`` parts are broadcast.
    With ``carry``, only keys, these columns and times are returned; they travel with the marks, so sources are not read again.
    Rows alike in keys, part and carried columns then come in one list, whatever their number.
    """
    asked = sources.withColumn("__sha", F.coalesce(F.sha2(part, 256), F.lit("")))
    own = list(carry or ())
    marked = asked.select(*keys, *own, F.char_length(part).alias("__length"), "__sha", _marks(part).alias("__m"))
    # empty and null parts are nulls, which no list takes up; a filter on texts would be pushed below the exchange behind which they are made
    entry = F.struct(F.col("__length").alias("length"), "__m.mark", "__m.head", F.col("__sha").alias("sha"), F.struct(F.lit(1).alias("__one"), *own).alias("own"))
    loads = sources.groupBy(*keys).agg(F.ceil(F.count("*") / at_most).alias("__loads")).where("__loads > 1")
    load = F.pmod(F.xxhash64("__sha", *own), F.coalesce("__loads", F.lit(1)))
    dealt = marked.join(F.broadcast(loads), [*keys], "left").select(*keys, F.when(F.col("__length") > 0, entry).alias("__p"), load.alias("__load"))
    lists = dealt.groupBy(*keys, "__load").agg((F.collect_set if carry is None else F.collect_list)("__p").alias("__parts"))
    shown = documents.select(*keys, F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    swept = shown.join(lists.hint("merge"), [*keys]).select(*keys, "__parts", _times("__text", F.transform("__parts", lambda p: p.dropFields("own"))).alias("__times"))
    found = swept.select(*keys, F.inline(F.arrays_zip(F.col("__parts.sha").alias("__sha"), F.col("__parts.own").alias("__own"), F.col("__times").alias("times"))))
    found = found.toDF(*keys, "__sha", "__own", "times")
    if carry is not None:
        return found.select(*keys, *[F.col("__own")[c].alias(c) for c in own], "times")
    return asked.join(found.drop("__own").hint("merge"), [*keys, "__sha"]).drop("__sha")
