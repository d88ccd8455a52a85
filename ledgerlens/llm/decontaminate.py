"""Benchmark passages in documents, found by the q-gram lemma and verified by banded alignment.

Texts are lower-cased and every stretch of white space counts as one blank.  A benchmark item of m characters
leaks where a document holds it with at most k = floor(budget * m) edits.  An edit spoils at most q q-grams,
so such a place shares at least m - q + 1 - k q character q-grams with the item, on diagonals that differ by
at most k.  Shared q-grams are counted in bands of 2w diagonals (w >= k + 1) that overlap by w, so that one
band holds them all; only bands that reach the bound are aligned, within the band.

The q-grams of the items are a table that every task holds; it is built from at most ``block_chars``
characters of benchmark at a time, and a larger benchmark takes as many passes over the documents as it has
such blocks.  Documents are never shuffled.

Items too short for that bound with k edits are looked up by shorter q-grams, the longest for which it is at
least 1; items too short for an edit and for a q-gram must occur whole.  Null or empty items never occur; null
or empty documents leak nothing; rows of the same id and text count as one item, other repeated items are each
reported.  Texts that repeat a q-gram of an item take time for each pair of its places, but no memory: pairs are
counted ``STRETCH`` at a time.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import importable

Q = 8
BUDGET = 0.1
BLOCK_CHARS = 2_000_000
BITS = 22
STRETCH = 4_000_000
NO_CHARACTER = 0xFFFFFFFF
LEAKS = "array<struct<item_id:long,start_char:int,end_char:int,edits:int>>"
MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(code: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each place on (64 bits; what it finds is verified)."""
    n = len(code) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, wide = np.zeros(n, np.uint64), code.astype(np.uint64)
    for i in range(q):
        out *= MIX
        out += wide[i : i + n]
    out ^= out >> np.uint64(32)
    out *= MIX
    return out


class Item(NamedTuple):
    item_id: int
    text: str
    code: np.ndarray
    edits: int
    least: int
    shift: int
    q: int


class Places:
    """The q-grams of some benchmark items, with the places where they occur."""

    def __init__(self, items: list[Item], q: int):
        self.q, self.items = q, items
        found = [grams(x.code, q) for x in items]
        every = np.concatenate(found) if found else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.keys, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every)).astype(np.int64)
        self.item = np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found])[order]
        self.place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in found])[order] if found else np.zeros(0, np.int32)
        self.shift = np.array([x.shift for x in items], np.int64)
        self.least = np.array([x.least for x in items], np.int64)
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def shared(self, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item and half band, number of shared q-grams), of one stretch of the text after the other.

        A q-gram that a text and an item both repeat is shared once for each pair of its places, so the pairs
        are formed for stretches of about ``STRETCH`` of them, which are counted before the next.
        """
        found = grams(code, self.q)
        at = np.flatnonzero(self.seen[(found >> np.uint64(64 - BITS)).astype(np.int64)])
        if not len(at):
            return
        found = found[at]
        key = np.searchsorted(self.keys, found)
        key[key == len(self.keys)] = 0
        same = self.keys[key] == found
        at, key = at[same], key[same]
        times = self.first[key + 1] - self.first[key]
        upto = np.cumsum(times)
        begin = 0
        while begin < len(at):
            before = upto[begin] - times[begin]
            end = max(begin + 1, int(np.searchsorted(upto, before + STRETCH, side="right")))
            here, n = slice(begin, end), upto[end - 1] - before
            posting = np.repeat(self.first[key[here]] - (upto[here] - times[here] - before), times[here]) + np.arange(n)
            item = self.item[posting]
            band = (np.repeat(at[here], times[here]) - self.place[posting]) >> self.shift[item]  # rounds down, also below 0
            yield counted(item.astype(np.int64), band, len(self.items))
            begin = end

    def bands(self, code: np.ndarray) -> list[tuple[int, int]]:
        """(item, band) whose shared q-grams reach the item's bound."""
        if not len(self.keys):
            return []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for names, count in self.shared(code):
            held.append((names, count))
            size += len(names)
            if size > STRETCH:
                held = [summed(held)]
                size = -len(held[0][0])  # so that sums are made each time the bands have doubled, not each stretch
        if not held:
            return []
        kept, count = summed(held)
        # a band of 2w diagonals is two neighbouring ones of w
        joined = count.copy()
        joined[:-1] += np.where(kept[1:] == kept[:-1] + 1, count[1:], 0)
        own = (kept >> 40).astype(np.int64)
        good = np.flatnonzero(joined >= self.least[own])
        # a lower neighbour that is empty itself leaves the upper half as its own first half: it is counted above
        return [(int(own[k]), int(kept[k] & ((1 << 40) - 1)) - (1 << 39)) for k in good]


def counted(item: np.ndarray, band: np.ndarray, items: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of item and band as one number each, in order, and how often each occurs."""
    low = int(band.min())
    span = int(band.max()) - low + 1
    if items * span <= 4 * len(item):  # few bands, many pairs: a repetitive text
        count = np.bincount(item * span + (band - low), minlength=0)
        names = np.flatnonzero(count)
        return (names // span << 40) + (names % span + low + (1 << 39)), count[names]
    return np.unique((item << 40) + (band + (1 << 39)), return_counts=True)


def summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the same names added up, names in order."""
    if len(counts) == 1:
        return counts[0]
    names, count = (np.concatenate(x) for x in zip(*counts, strict=True))
    order = np.argsort(names, kind="stable")
    names = names[order]
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    return names[first], np.add.reduceat(count[order], first)


class Index:
    """A block of benchmark items, by the length of q-grams that their edits leave whole."""

    def __init__(self, rows: list[tuple[int, str]], q: int = Q, budget: float = BUDGET):
        self.short: list[tuple[int, str]] = []
        self.items: list[Item] = []
        for item_id, text in rows:
            text = normal(text)
            m = len(text)
            edits = math.floor(budget * m)
            if not m:
                continue
            if m < q and not edits:
                self.short.append((item_id, text))
                continue
            own = next((n for n in range(q, 1, -1) if m - n + 1 - edits * n >= 1), 1)
            self.items.append(Item(item_id, text, codes(text), edits, max(1, m - own + 1 - edits * own), (edits + 1).bit_length(), own))
        self.places = [Places([x for x in self.items if x.q == n], n) for n in sorted({x.q for x in self.items})]

    def leaks(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """Every place of an item in a text: item_id, start and end in the normalised text, edits."""
        text = normal(text)
        if not text:
            return []
        code = codes(text)
        out = {(item_id, at, at + len(part), 0) for item_id, part in self.short for at in places(text, part)}
        for group in self.places:
            best: dict[int, set[tuple[int, int, int]]] = {}
            for k, band in group.bands(code):
                item = group.items[k]
                low = (band << item.shift) - item.edits
                high = low + (2 << item.shift) + 2 * item.edits
                start, stop = max(0, low), min(len(text), high + len(item.text))
                exact = [(0, start + at, start + at + len(item.text)) for at in places(text[start:stop], item.text)]
                near = [] if exact else [x for x in [align(item.code, code, item.edits, low, high)] if x]
                best.setdefault(k, set()).update(exact or near)
            for k, found in best.items():
                out.update((group.items[k].item_id, a, b, edits) for edits, a, b in apart(found))
        return sorted(out)


def apart(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of places that overlap the one with the fewest edits, then the first."""
    out: list[tuple[int, int, int]] = []
    starts: list[int] = []
    ends: list[int] = []
    for edits, a, b in sorted(found):
        at = bisect.bisect_right(starts, a)  # those taken lie apart, so only two neighbours can overlap
        if (not at or ends[at - 1] <= a) and (at == len(starts) or b <= starts[at]):
            starts.insert(at, a)
            ends.insert(at, b)
            out.append((edits, a, b))
    return out


def places(text: str, part: str) -> list[int]:
    out, at = [], text.find(part)
    while at >= 0:
        out.append(at)
        at = text.find(part, at + len(part))
    return out


def align(item: np.ndarray, text: np.ndarray, edits: int, low: int, high: int) -> tuple[int, int, int] | None:
    """Best alignment of the whole item with a place of the text, if within the budget: edits, start, end.

    Only cells on the diagonals ``low`` to ``high`` (place in the text less place in the item) are filled: one
    row of that width per character of the item.  Gaps along the row are resolved by a running minimum.  Of
    equally good ends the first one counts, with its leftmost start.
    """
    n, m, width = len(text), len(item), high - low + 1
    around = np.full(width + m, NO_CHARACTER, np.uint32)  # the text from place low on
    start, stop = max(0, low), min(n, low + len(around))
    if start < stop:
        around[start - low : stop - low] = text[start:stop]
    wide = width + 1
    steps = np.arange(width, dtype=np.int64)
    gaps = steps * wide
    outside = (edits + 1) * wide
    # cost and start travel in one number, so that the smallest cost takes its leftmost start along
    row = steps + np.where((steps + low >= 0) & (steps + low <= n), 0, outside)
    new = np.empty(width, np.int64)
    for i, c in enumerate(item):
        np.add(row, (around[i : i + width] != c) * wide, out=new)
        np.minimum(new[:-1], row[1:] + wide, out=new[:-1])
        new -= gaps
        np.minimum.accumulate(new, out=new)
        new += gaps
        row, new = new, row
        if row.min() // wide > edits:
            return None
    cost = np.where((steps + low + m >= 0) & (steps + low + m <= n), row // wide, edits + 1)
    end = int(np.argmin(cost))
    return (int(cost[end]), low + int(row[end] % wide), low + end + m) if cost[end] <= edits else None


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> list[Index]:
    """Indexes of the whole benchmark, none over more than about ``block_chars`` characters of several items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.char_length("text")).alias("n")).first().n or 0
    n = max(1, math.ceil(total / block_chars))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [Index([tuple(r) for r in items.where(block == k).orderBy("item_id", "text").collect()]) for k in range(n)]


def leaks(text: Column, index: Index) -> Column:
    """The places of benchmark items in each text: array of item_id, start_char, end_char, edits."""
    importable()

    @F.pandas_udf(LEAKS)
    def found(values: pd.Series) -> pd.Series:
        return pd.Series([[{"item_id": i, "start_char": a, "end_char": b, "edits": e} for i, a, b, e in index.leaks(x)]
                          for x in values], dtype="object")
    return found.asNondeterministic()(text)  # so that no plan evaluates it twice


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, start_char, end_char, edits: one row for each place of an item in a document."""
    out = None
    for index in benchmark_blocks(benchmark, block_chars):
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), leaks(F.col("text"), index).alias("leak"))
        found = found.select("doc_id", F.explode("leak").alias("leak")).select("doc_id", "leak.*")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    for index in benchmark_blocks(benchmark, block_chars):
        docs = docs.where(F.size(leaks(F.col("text"), index)) == 0)
    return docs
