"""Exact Jaccard self-join of documents on word shingles, as classes of documents that links connect.

Two documents link when 100 |x & y| >= threshold |x | y| for their sets of shingles.  Equal sets form one
node, represented by its smallest doc_id.  Frequent shingles are found first; every set is ordered by how
frequent its shingles are (rare first, then by hash), and only a prefix of it enters the inverted lists: two
sets that link share a shingle of both prefixes.

The lists are skipped through, not paired up:

* by position: a list is ordered by set size and cut into blocks within which sizes allow a link; an entry
  whose place in its prefix leaves too few shingles behind it is passed over, and so are pairs that meet in
  fewer lists than their sizes ask for: beyond the prefixes no more than n - p shingles can be shared;
* by relation: each block has a leader, the set with the largest share of frequent shingles, and each set is
  verified against one leader first.  Sets that are linked by then are one class, and a list in which only
  one class is left is skipped whole;
* by computed answers: for two sets x and y with verified overlaps with the same leader r,

      |x & r| + |y & r| - |r|  <=  |x & y|  <=  min(|x & r| + |y \\ r|, |y & r| + |x \\ r|),

  so many links follow or fall without looking at the sets; only what stays open is verified.

All pairs across classes that pass go through, whatever their number, so no class is missed.  Null texts and
texts without words have empty sets and link with nothing.  Repeated rows are equal sets.  Hashes have 64 bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import importable, materialize, text_bytes, texts
from ledgerlens.llm.exchange import bucket_bounds
from ledgerlens.llm.graphs import Sieve, components
from ledgerlens.llm.words import shingle_sets

#: Frequent shingles that every task holds: the most frequent ones, this many at most.
FREQUENT = 1_000_000
#: Shingles that a task counts at a time.
PORTION = 2_000_000
BUCKET_BYTES = 64_000_000
BATCH_BYTES = 2_000_000
NODES = "doc_id long, n int, node binary, bucket int, keys binary, counts binary"
POSTINGS = "shingle long, node binary, n int, place int, frequent int"
LISTED = "shingle long, node binary, n int, place int, leader binary, leader_n int"
PAIRS = "a binary, na int, b binary, nb int"
PREFIXES = "node binary, n int, shingles binary, places binary, leader binary, leader_n int"


def portions(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """Ids and texts of a batch, some millions of bytes at a time (a longer text by itself)."""
    size = np.cumsum(pc.binary_length(batch["text"]).to_numpy().astype(np.int64))
    first = 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + BATCH_BYTES, "right")))
        part = batch.slice(first, last - first)
        yield part["doc_id"].to_pylist(), part["text"].to_pylist()
        first = last


def node_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())[:12]


def required(n: np.ndarray, m: np.ndarray, threshold: int) -> np.ndarray:
    """Smallest overlap at which sets of these sizes link."""
    return -(-threshold * (n + m) // (100 + threshold))


def census(docs: DataFrame, size: int, n_buckets: int) -> DataFrame:
    """Node of every document; and, packed, the shingles that occur in several sets of one portion, with counts."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, None] = {}
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            keys, counts = keys[counts > 1], counts[counts > 1].astype("<u4")
            ends = bucket_bounds(keys, n_buckets)
            full = np.flatnonzero(np.diff(ends))
            seen.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([
                pa.nulls(len(full), pa.int64()), pa.nulls(len(full), pa.int32()), pa.nulls(len(full), pa.binary()), pa.array(full.astype(np.int32)),
                pa.array([keys[ends[b] : ends[b + 1]].tobytes() for b in full], pa.binary()),
                pa.array([counts[ends[b] : ends[b + 1]].tobytes() for b in full], pa.binary())], ["doc_id", "n", "node", "bucket", "keys", "counts"])

        for batch in batches:
            for ids, part in portions(batch):
                sets = shingle_sets(part, size)
                nodes = [node_of(s) for s in sets]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(nodes, pa.binary()),
                    pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], ["doc_id", "n", "node", "bucket", "keys", "counts"])
                for node, s in zip(nodes, sets, strict=True):
                    if len(s) and node not in seen:
                        seen[node] = None
                        held.append(s)
                        total += len(s)
                if total >= PORTION:
                    yield flush()
                    total = 0
        if held:
            yield flush()
    return texts(docs).mapInArrow(run, NODES)


def frequent_shingles(counted: DataFrame, at_most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, rising, and the logarithm of their counts; ``at_most`` of them.

    They decide in which order the shingles of a set are read, never which sets link.
    """
    def merge(rows: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in rows["keys"]])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in rows["counts"]])
        keys, of = np.unique(keys, return_inverse=True)
        level = np.log2(np.bincount(of, counts)).astype(np.int32)
        found = np.unique(level)
        return pa.table({"level": pa.array(found), "n": pa.array([int((level == x).sum()) for x in found], pa.int64()),
                         "keys": pa.array([keys[level == x].tobytes() for x in found], pa.binary())})

    merged = materialize(counted.where("keys is not null").select("bucket", "keys", "counts").groupBy("bucket")
                         .applyInArrow(merge, "level int, n long, keys binary"), "frequent")
    least, held = 64, 0
    for row in merged.groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():  # one row per power of 2
        held += row.n
        if held > at_most:
            break
        least = row.level
    found = merged.where(F.col("level") >= least).select("level", "keys").collect()
    keys = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(r["keys"], "<u8") for r in found)])
    levels = np.concatenate([np.zeros(0, np.uint8), *(np.full(len(r["keys"]) // 8, r.level, np.uint8) for r in found)])
    order = np.argsort(keys)
    return keys[order], levels[order]


def postings(docs: DataFrame, size: int, threshold: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The prefix of every set, rare shingles first: one row for each, once per task for equal sets."""
    keys, levels = frequent

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for _, part in portions(batch):
                out = []
                for s in shingle_sets(part, size):
                    n = len(s)
                    if not n or (node := node_of(s)) in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(node)
                    at = np.searchsorted(keys, s)
                    level = np.zeros(n, np.uint8)
                    if len(keys):
                        at[at == len(keys)] = 0
                        level = np.where(keys[at] == s, levels[at], 0)
                    order = np.lexsort((s, level))[: n - -(-threshold * n // 100) + 1]
                    out.append((s[order], node, n, int((level > 0).sum())))
                if out:
                    sizes = [len(x[0]) for x in out]
                    each = np.repeat(np.arange(len(out)), sizes)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate([x[0] for x in out]).view(np.int64)),
                        pa.array([x[1] for x in out], pa.binary()).take(pa.array(each)),
                        pa.array(np.array([x[2] for x in out], np.int32)[each]),
                        pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])),
                        pa.array(np.array([x[3] for x in out], np.int32)[each])], ["shingle", "node", "n", "place", "frequent"])
    return texts(docs).mapInArrow(run, POSTINGS)


def runs(batches: Iterable[pa.RecordBatch], key: str = "shingle") -> Iterator[pa.Table]:
    """Stretches of whole lists from batches that are ordered by key."""
    held: list[pa.RecordBatch] = []
    open_key = None
    for batch in batches:
        keys = batch[key].to_numpy()
        if not len(keys):
            continue
        if held and keys[0] != open_key:
            yield pa.Table.from_batches(held)
            held = []
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
        open_key = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def bounds_of(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))


def lists(rows: DataFrame, threshold: int) -> DataFrame:
    """Entries of the lists that hold several sets, each with the leader of its block if that could link."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches):
            part = part.combine_chunks()
            keys = part["shingle"].to_numpy()
            nodes = np.array(part["node"].to_pylist(), dtype=object)
            # equal sets from several tasks stand next to each other
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
            first = bounds_of(keys[new])
            several = np.repeat(np.diff(first) > 1, np.diff(first))
            at = np.flatnonzero(new)[several]
            if not len(at):
                continue
            keys, nodes = keys[at], nodes[at]
            n, place, hot = (part[c].to_numpy()[at].astype(np.int64) for c in ("n", "place", "frequent"))
            leader = np.arange(len(at))
            first = bounds_of(keys)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                while a < b:  # one block: the sizes that can link with its smallest
                    end = a + int(np.searchsorted(n[a:b], 100 * n[a] // threshold, "right"))
                    leader[a:end] = a + int(np.argmax(hot[a:end] / n[a:end]))
                    a = end
            room = np.minimum(n - place, n[leader] - place[leader])
            good = (leader != np.arange(len(at))) & (room >= required(n, n[leader], threshold))
            yield pa.RecordBatch.from_arrays([
                pa.array(keys), pa.array(nodes, pa.binary()), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32)),
                pa.array(np.where(good, nodes[leader], None), pa.binary()), pa.array(n[leader].astype(np.int32))],
                ["shingle", "node", "n", "place", "leader", "leader_n"])
    return rows.repartition("shingle").sortWithinPartitions("shingle", "n", "node").mapInArrow(run, LISTED)


def across(listed: DataFrame, threshold: int) -> DataFrame:
    """Pairs of sets of different classes that meet in a list where places and sizes allow a link.

    ``listed`` has a column root; a list of one class is skipped, and so is each entry's own class.  Of the
    lists in which two sets meet, the first leaves the most shingles behind it, so the places of each list
    may be judged as if the two met there for the first time.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches):
            part = part.combine_chunks()
            keys, n, place = part["shingle"].to_numpy(), part["n"].to_numpy().astype(np.int64), part["place"].to_numpy().astype(np.int64)
            roots = part["root"].combine_chunks().dictionary_encode().indices.to_numpy()
            nodes = part["node"].combine_chunks()
            order = nodes.dictionary_encode()
            rank = np.argsort(np.argsort(np.array(order.dictionary.to_pylist(), dtype=object)))[order.indices.to_numpy()]
            first = bounds_of(keys)
            left, right = [], []

            def pairs() -> pa.RecordBatch:
                i, j = np.concatenate(left), np.concatenate(right)
                i, j = np.where(rank[i] < rank[j], i, j), np.where(rank[i] < rank[j], j, i)
                return pa.RecordBatch.from_arrays([nodes.take(pa.array(i)), pa.array(n[i].astype(np.int32)), nodes.take(pa.array(j)),
                                                   pa.array(n[j].astype(np.int32))], ["a", "na", "b", "nb"])

            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if (roots[a:b] == roots[a]).all():
                    continue
                ends = a + np.searchsorted(n[a:b], 100 * n[a:b] // threshold, "right")
                for i in range(a, b):
                    j = np.arange(i + 1, ends[i - a])
                    room = np.minimum(n[i] - place[i], n[j] - place[j])
                    j = j[(roots[j] != roots[i]) & (room >= required(n[i], n[j], threshold))]
                    if len(j):
                        left.append(np.full(len(j), i))
                        right.append(j)
                if sum(map(len, left)) > 500_000:
                    yield pairs()
                    left.clear()
                    right.clear()
            if left:
                yield pairs()

    return listed.repartition("shingle").sortWithinPartitions("shingle", "n", "node").mapInArrow(run, PAIRS)


def prefixes(listed: DataFrame) -> DataFrame:
    """For each set its shared shingles with their places, and the leader of most of its lists."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch["entries"]:
                at = row.values
                shingles, places = at.field("shingle").to_numpy(), at.field("place").to_numpy()
                order = np.argsort(shingles)
                led = Counter(zip(at.field("leader").to_pylist(), at.field("leader_n").to_pylist(), strict=True))
                best = max(((k, *who) for who, k in led.items() if who[0] is not None), default=(0, None, None))
                out.append((shingles[order].tobytes(), places[order].tobytes(), best[1], best[2]))
            kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["node"], batch["n"], *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))],
                                             ["node", "n", "shingles", "places", "leader", "leader_n"])

    held = listed.groupBy("node", "n").agg(F.collect_list(F.struct("shingle", "place", "leader", "leader_n")).alias("entries"))
    return held.select("node", "n", "entries").mapInArrow(run, PREFIXES)


def entries(prefixed: DataFrame) -> DataFrame:
    """One row for each shared shingle of a set: shingle, node, n, place, root."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = [np.frombuffer(x, np.int64) for x in batch["shingles"].to_pylist()]
            at = pa.array(np.repeat(np.arange(len(shingles)), [len(x) for x in shingles]))
            places = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x, np.int32) for x in batch["places"].to_pylist())])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *shingles])), batch["node"].take(at), batch["n"].take(at),
                                              pa.array(places), batch["root"].take(at)], ["shingle", "node", "n", "place", "root"])
    return prefixed.select("node", "n", "shingles", "places", "root").mapInArrow(run, "shingle long, node binary, n int, place int, root binary")


def common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` with the number of shingles that two sets (node, shingles) share: column common."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                      for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("a", "na", "b", "nb")), pa.array(shared, pa.int32())], ["a", "na", "b", "nb", "common"])

    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "na", "b", "nb", "x", "y"))
    return both.mapInArrow(run, PAIRS + ", common int")


def likely(pairs: DataFrame, prefixed: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose prefixes share enough: beyond them they share n - p shingles at most."""
    def beyond(n: str):
        return F.ceil(F.col(n) * threshold / F.lit(100)) - 1

    enough = F.col("common") >= needed(threshold) - F.greatest(beyond("na"), beyond("nb"))
    return common(pairs, prefixed.select("node", "shingles")).where(enough).drop("common")


def needed(threshold: int):
    return F.ceil(threshold * (F.col("na") + F.col("nb")) / F.lit(100 + threshold))


def sets_of(docs: DataFrame, size: int, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes and a few others, from the document that represents each.

    A node can come from several tasks where rows repeat a doc_id or have none; links are made distinct after.
    """
    ids = nodes.join(wanted, "node", "left_semi").select("doc_id")
    sieve = Sieve(ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            ids = batch["doc_id"]
            held = sieve.may_hold(ids.fill_null(0).to_numpy()) | ids.is_null().to_numpy(zero_copy_only=False)
            for _, part in portions(batch.filter(pa.array(held))):
                out = {}
                for s in shingle_sets(part, size):
                    if len(s) and (node := node_of(s)) not in seen:
                        out[node] = s.tobytes()
                if len(seen) > 200_000:
                    seen.clear()
                seen.update(out)
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], ["node", "shingles"])

    return materialize(texts(docs).mapInArrow(run, "node binary, shingles binary"), "sets")


def classes(docs: DataFrame, size: int = 4, threshold: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach), n_links (verified links of its set), node, root.

    node stands for the set (null: no words), root for all sets that links connect: rows that share a doc_id are told apart by them.
    """
    importable()
    n_buckets = max(1, -(-text_bytes(docs) // BUCKET_BYTES))
    counted = materialize(census(docs, size, n_buckets), "shingle-census")
    frequent = frequent_shingles(counted)
    of = counted.where("node is not null").select("doc_id", "n", "node")
    nodes = of.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    listed = materialize(lists(postings(docs, size, threshold, frequent), threshold), "lists")

    need = needed(threshold)
    linked = F.col("common") * 100 >= threshold * (F.col("na") + F.col("nb") - F.col("common"))
    prefixed = materialize(prefixes(listed), "prefixes")
    led = prefixed.where("leader is not null").select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("leader").alias("b"), F.col("leader_n").alias("nb"))
    led = materialize(likely(led, prefixed, threshold), "leaders")
    ends = led.select(F.col("a").alias("node")).union(led.select("b")).distinct()
    sets = sets_of(docs, size, nodes, ends)
    first = materialize(common(led, sets), "leader-overlaps")
    roots = materialize(components(first.where(linked).select("a", "b")), "roots")

    named = prefixed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    met = across(entries(named), threshold).distinct()
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    to_leader = first.select(F.col("a").alias("x"), F.col("b").alias("r"), F.col("nb").alias("r_n"), "common")
    of_a = to_leader.select(F.col("x").alias("a"), F.col("r").alias("ra"), F.col("r_n"), F.col("common").alias("ca"))
    of_b = to_leader.select(F.col("x").alias("b"), F.col("r").alias("rb"), F.col("common").alias("cb"))
    same = F.coalesce(F.col("ra") == F.col("rb"), F.lit(False))
    least = F.when(same, F.col("ca") + F.col("cb") - F.col("r_n")).otherwise(0)
    most = F.when(same, F.least(F.col("ca") + F.col("nb") - F.col("cb"), F.col("cb") + F.col("na") - F.col("ca"))).otherwise(F.least("na", "nb"))
    judged = (met.join(tried, ["a", "b"], "left_anti").join(of_a, "a", "left").join(of_b, "b", "left")
              .withColumn("least", least).withColumn("most", most).where(F.col("most") >= need))
    judged = materialize(judged.select("a", "na", "b", "nb", (F.col("least") >= need).alias("sure")), "pairs")
    still = materialize(likely(judged.where(~F.col("sure")).drop("sure"), prefixed, threshold), "open-pairs")
    known = sets
    late = still.select(F.col("a").alias("node")).union(still.select("b")).distinct().join(sets, "node", "left_anti")
    late = materialize(late, "late")
    if not late.isEmpty():
        known = sets.unionByName(sets_of(docs, size, nodes, late))
    second = materialize(common(still, known), "pair-overlaps")

    links = (first.where(linked).select("a", "b").unionByName(second.where(linked).select("a", "b"))
             .unionByName(judged.where("sure").select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = components(links)
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    owned = roots.join(nodes, "node")
    smallest = (owned.join(owned.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root")
                .select("node", "root", "component_id").join(degree, "node", "left"))
    alone = nodes.select("node", F.col("doc_id").alias("own"))
    return (of.join(alone, "node", "left").join(smallest, "node", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.coalesce("component_id", F.when(F.col("n") > 0, F.col("own")), "doc_id").alias("component_id"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n") > 0, F.col("node")).alias("node"),
                    F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("root")))


def without_copies(docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """One row of all that links connect, the one with the smallest doc_id (null: last); rows without words stay.

    Rows are told apart by doc_id and set of shingles, so texts that share a doc_id are judged each by itself.  Of rows
    with the same doc_id and set the smallest text stays, and any one of those that are equal in both.  Only rows whose
    doc_id the sieve holds back are read again, and only those that may go are joined; all other columns are carried whole.
    """
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node")
    members = classes(docs, size, threshold).where("node is not null").groupBy("root", "doc_id", "node").agg(F.count("*").alias("copies"))
    members = materialize(members.withColumn("place", place), "members")
    first = members.groupBy("root").agg(F.min("place").alias("first"), F.sum("copies").alias("rows")).where(F.col("rows") > 1)
    judged = members.join(first, "root").select("doc_id", "node", "copies", (F.col("place") == F.col("first")).alias("stays"))
    judged = materialize(judged.where(~F.col("stays") | (F.col("copies") > 1)).drop("copies"), "near-copies")
    sieve = Sieve(judged.select("doc_id"))

    @F.pandas_udf("boolean")
    def maybe(ids: pd.Series) -> pd.Series:
        return pd.Series(sieve.may_hold(ids.fillna(0).to_numpy().astype(np.int64)) | ids.isna().to_numpy())

    @F.pandas_udf("held boolean, set binary")
    def asked_set(ids: pd.Series, values: pd.Series) -> pd.DataFrame:
        """Whether a row's id is held and, where it is, its set: one worker of a task does both."""
        held = sieve.may_hold(ids.fillna(0).to_numpy().astype(np.int64)) | ids.isna().to_numpy()
        sets = [next((node_of(s) for s in shingle_sets([t], size) if len(s)), None) if h else None for h, t in zip(held, values, strict=True)]
        return pd.DataFrame({"held": held, "set": pd.Series(sets, dtype="object")})

    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"))
    held = maybe(F.col("id"))
    both = asked_set.asNondeterministic()(F.col("id"), F.coalesce("row.text", F.lit("")))  # so that no plan evaluates it twice
    asked = named.withColumn("asked", both).where("asked.held").select("row", "id", F.col("asked.set").alias("set"))
    told = asked.join(judged, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("set") == F.col("node")), "left")
    told = materialize(told.where(F.coalesce("stays", F.lit(True))).select("row", "id", "set", F.col("stays").isNotNull().alias("repeated")), "held")
    one = told.where("repeated").groupBy("id", "set").agg(F.min_by("row", F.col("row.text")).alias("row"))
    kept = named.where(~held).select("row").unionByName(told.where("not repeated").select("row")).unionByName(one.select("row"))
    return kept.select("row.*")
