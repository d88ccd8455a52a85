"""Phrases of two to five words that stand together more often than their parts suggest.

Texts are lower-cased in A to Z, split into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and
tabs.  Everything is counted per language.  A phrase never crosses a piece, and counts include overlaps.

1.  Words are counted with their texts.  A word that is rarer than ``least`` ends every phrase.
2.  Leading pairs of frequent words are counted over the whole corpus; rarer pairs are abandoned.
3.  Every suffix of a piece whose first two pairs are left is cut to ``DEPTH`` words, or where a rare pair comes
    first.  A task merges equal suffixes and routes them by their leading pair into buckets, so that whatever begins
    with that pair meets there.  In a bucket, a multikey three-way quicksort orders pointers to the suffixes:
    each partition is parted by one word into smaller, equal and larger ones; the equal ones go on with the next
    word, their size is the count of the phrase so far, and partitions of fewer than ``least`` are abandoned.
    A pair of more than ``HOT`` occurrences is dealt to buckets by whole suffixes instead: their parts of the counts
    are summed over the buckets before anything is abandoned.
4.  Scores, cuts and containment are joins of the frequent phrases.

Which words and pairs are frequent is handed to tasks as bits of fixed size (``graphs.Sieve``); what passes them in
error is counted and found too rare, so bits decide the cost and never the result.

A phrase of count a, cut after k words into parts of counts l and r, scores floor(1000 a n / (l r)), n being the
words of its language; the lowest cut counts, the first of equal ones.  A candidate goes if a longer one that
holds it has at least ``cover`` percent of its count.  Arithmetic is exact in decimals of 38 digits.

Null texts are empty and null languages ``und``; empty texts and tables give no rows; repeated rows count each.
Words are told apart by 64-bit hashes of language and word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import importable, materialize
from ledgerlens.llm.graphs import Sieve

LEAST = 100
DEPTH = 5
COVER = 100
FIRST = 2000
HOT = 500_000
BUCKET_ROWS = 500_000
HELD_WORDS = 100_000
HELD_PAIRS = 400_000
HELD_SUFFIXES = 200_000
SENT_ROWS = 50_000
TURN = 23
BREAK = b"\xff"  # no byte of UTF-8
BREAKS = bytes.maketrans(b".,;:!?\n\v\f\r", BREAK * 10)
WHOLE = "decimal(20,0)"


def pieces_of(text: bytes) -> list[bytes]:
    """Words of a text in order, with BREAK between pieces."""
    return text.lower().translate(BREAKS).replace(BREAK, b" \xff ").split()  # bytes: only A-Z change, blanks and tabs are left


class Keys:
    """64-bit hashes of the words of one language; 0 stands for a break and for words the sieve holds back."""

    def __init__(self, lang: bytes, sieve: Sieve | None = None):
        self.start, self.sieve, self.known = xxhash.xxh3_64_intdigest(lang), sieve, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        new = list(set(words).difference(self.known))
        keys = np.fromiter((0 if w == BREAK else max(1, xxhash.xxh3_64_intdigest(w, self.start)) for w in new), np.uint64, len(new))
        if self.sieve is not None:
            keys[~self.sieve.may_hold(keys.view(np.int64))] = 0
        self.known.update(zip(new, keys.tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def lang_texts(docs: DataFrame) -> DataFrame:
    importable()
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).cast("binary").alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def sent(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, rows.num_rows, SENT_ROWS):
        yield rows.slice(at, SENT_ROWS)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word (binary), key and f of every word."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Counter[bytes]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                words.pop(BREAK, None)
                yield from sent(pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(words), pa.binary()), "word": pa.array(words.keys(), pa.binary()),
                    "key": Keys(lang).of(list(words)).view(np.int64), "f": pa.array(words.values(), pa.int64())}))
            held.clear()
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(pieces_of(text))
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from rows()
        yield from rows()
    return lang_texts(docs).mapInArrow(count, "lang binary, word binary, key long, f long").groupBy("lang", "word", "key").agg(F.sum("f").alias("f"))


def key_runs(batches: Iterable[pa.RecordBatch], sieve: Sieve) -> Iterator[np.ndarray]:
    """The keys of each batch of texts one after the other, 0 wherever a phrase must end."""
    of_lang: dict[bytes, Keys] = {}
    for batch in batches:
        if sum(len(x.known) for x in of_lang.values()) > HELD_WORDS:
            of_lang.clear()
        words: dict[bytes, list[bytes]] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words.setdefault(lang, [BREAK]).extend(pieces_of(text))
            words[lang].append(BREAK)
        if words:
            yield np.concatenate([of_lang.setdefault(lang, Keys(lang, sieve)).of(ws) for lang, ws in words.items()])


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key of two hashes, the second turned by some bits: what pair_key says in Spark."""
    return a ^ (b << np.uint64(TURN) | b >> np.uint64(64 - TURN))


def pair_key() -> Column:
    return F.col("a").bitwiseXOR(F.shiftleft("b", TURN).bitwiseOR(F.shiftrightunsigned("b", 64 - TURN)))


def merged(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of the columns as one, their numbers added."""
    order = np.lexsort(columns[::-1])
    columns, n = [c[order] for c in columns], n[order]
    new = np.ones(len(n), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    starts = np.flatnonzero(new)
    return [c[starts] for c in columns], np.add.reduceat(n, starts) if len(n) else n


def pair_counts(docs: DataFrame, frequent: Sieve, least: int) -> DataFrame:
    """a, b, f of the pairs that occur ``least`` times or more."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            if held:
                (a, b), n = merged([np.concatenate(x) for x in zip(*((p[0], p[1]) for p in held), strict=True)], np.concatenate([p[2] for p in held]))
                held.clear()
                yield from sent(pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64), "n": n}))
        for keys in key_runs(batches, frequent):
            at = np.flatnonzero((keys[1:] != 0) & (keys[:-1] != 0))
            (a, b), n = merged([keys[at], keys[at + 1]], np.ones(len(at), np.int64))
            held.append((a, b, n))
            size += len(n)
            if size > HELD_PAIRS:
                yield from rows()
                size = 0
        yield from rows()
    counted = lang_texts(docs).mapInArrow(count, "a long, b long, n long")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def sorted_partitions(words: np.ndarray, n: np.ndarray, least: int, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, one suffix, count) of every phrase of the suffixes ``words`` (rows, 0 after their end) with count ``least`` or more.

    A multikey three-way quicksort, all partitions of a round at once: ``pointer`` lists suffixes partition after partition,
    ``level`` is the number of words in which the suffixes of a partition agree.
    """
    pointer, start, level = np.arange(len(n)), np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(pointer):
        size = np.diff(np.append(start, len(pointer)))
        of = np.repeat(np.arange(len(start)), size)
        key = words[pointer, level[of]]
        pivot = key[start + size // 2]
        side = (key > pivot[of]).astype(np.int64) * 2 + (key == pivot[of])  # 0 smaller, 1 equal, 2 larger
        group = of * 3 + side
        order = np.argsort(group, kind="stable")
        pointer, group = pointer[order], group[order]
        start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        total, parted = np.add.reduceat(n[pointer], start), group[start]
        of, side = parted // 3, parted % 3
        equal = (side == 1) & (pivot[of] != 0) & (total >= least)  # 0: the suffix has ended
        for k in range(depth):
            found = equal & (level[of] == k)
            if found.any():
                yield k + 1, pointer[start[found]], total[found]
        on = (total >= least) & (~(side == 1) | (equal & (level[of] + 1 < depth)))
        size = np.diff(np.append(start, len(pointer)))
        pointer = pointer[np.repeat(on, size)]
        level = (level[of] + (side == 1))[on]
        start = np.cumsum(size[on]) - size[on]


def longer_phrases(docs: DataFrame, frequent: Sieve, pairs: DataFrame, least: int, depth: int = DEPTH, hot: int = HOT,
                   bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """words (array of keys) and f of the phrases of three to ``depth`` words that occur ``least`` times or more."""
    n_buckets = max(1, math.ceil((pairs.agg(F.sum("f").alias("n")).first().n or 0) / bucket_rows))
    left, dealt = Sieve(pairs.select(pair_key())), Sieve(pairs.where(F.col("f") > hot).select(pair_key()))

    def suffixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            columns, n = merged([np.concatenate([p[0][k] for p in held]) for k in range(depth)], np.concatenate([p[1] for p in held]))
            held.clear()
            lead = joined(columns[0], columns[1])
            split = dealt.may_hold(lead.view(np.int64))
            whole = lead
            for c in columns[2:]:
                whole = joined(c, whole)
            bucket = (np.where(split, whole, lead) % np.uint64(n_buckets)).astype(np.int32)
            order = np.lexsort((split, bucket))
            words, n, bucket, split = np.stack(columns, axis=1)[order], n[order], bucket[order], split[order]
            ends = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (split[1:] != split[:-1])))
            parts = list(zip(ends, np.append(ends[1:], len(n)), strict=True))
            yield pa.RecordBatch.from_pydict({
                "bucket": bucket[ends], "split": pa.array(split[ends]), "words": pa.array([words[x:y].astype("<u8").tobytes() for x, y in parts], pa.binary()),
                "n": pa.array([n[x:y].astype("<i8").tobytes() for x, y in parts], pa.binary())})
        for keys in key_runs(batches, frequent):
            known = np.zeros(len(keys) + depth, bool)  # whether a word and the next are a frequent pair
            at = np.flatnonzero((keys[1:] != 0) & (keys[:-1] != 0))
            known[at[left.may_hold(joined(keys[at], keys[at + 1]).view(np.int64))]] = True
            at = np.flatnonzero(known[:-1] & known[1:])
            if not len(at):
                continue
            columns, going = [keys[at], keys[at + 1]], np.ones(len(at), bool)
            for k in range(2, depth):
                going &= known[at + k - 1]
                columns.append(np.where(going, keys[np.minimum(at + k, len(keys) - 1)], np.uint64(0)))
            columns, n = merged(columns, np.ones(len(at), np.int64))
            held.append((columns, n))
            size += len(n)
            if size > HELD_SUFFIXES:
                yield from rows()
                size = 0
        yield from rows()

    def mine(rows: pa.Table) -> pa.Table:
        found = []
        for split in (False, True):
            some = [i for i, x in enumerate(rows["split"].to_pylist()) if x == split]
            if some:
                words = np.concatenate([np.frombuffer(rows["words"][i].as_buffer(), "<u8") for i in some]).reshape(-1, depth)
                n = np.concatenate([np.frombuffer(rows["n"][i].as_buffer(), "<i8") for i in some])
                for k, one, total in sorted_partitions(words, n, 1 if split else least, depth):
                    if k > 2:
                        ends = np.arange(len(one) + 1, dtype=np.int32) * k
                        found.append(pa.table({"words": pa.ListArray.from_arrays(ends, pa.array(words[one, :k].ravel().view(np.int64))), "n": total}))
        return pa.concat_tables(found) if found else pa.table({"words": pa.array([], pa.list_(pa.int64())), "n": pa.array([], pa.int64())})

    sent = lang_texts(docs).mapInArrow(suffixes, "bucket int, split boolean, words binary, n binary")
    parts = sent.groupBy("bucket").applyInArrow(mine, "words array<long>, n long")
    return parts.groupBy("words").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def mine_phrases(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, cover: int = COVER, first: int = FIRST,
                 hot: int = HOT, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``first`` phrases of each language."""
    words = materialize(word_counts(docs), "word-counts")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    singles = words.where(F.col("f") >= least)
    frequent = Sieve(singles.select("key"))
    pairs = materialize(pair_counts(docs, frequent, least), "pair-counts")
    longer = longer_phrases(docs, frequent, pairs, least, depth, hot, bucket_rows)
    found = pairs.select(F.array("a", "b").alias("words"), "f").unionByName(longer)
    # what passed a sieve in error has been counted since: a frequent phrase has frequent words and pairs only
    spelled = found.select("words", "f", F.posexplode("words").alias("at", "key")).join(singles.select("lang", "word", "key"), "key")
    spelled = spelled.groupBy("words", "f").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("texts"))
    phrase = F.concat_ws(" ", F.transform("texts", lambda x: x["word"].cast("string")))
    phrases = materialize(spelled.select("words", "f", "lang", phrase.alias("phrase")), "phrases")

    size = F.size("words")
    inner = phrases.where(size > 2).withColumn("k", F.explode(F.sequence(F.lit(2), size - 1))) \
        .select(F.col("f").alias("held"), F.explode(F.transform(F.sequence(F.lit(1), size - F.col("k") + 1), lambda i: F.slice("words", i, F.col("k")))).alias("words"))
    covered = inner.groupBy("words").agg(F.max("held").alias("held"))
    free = phrases.join(covered, "words", "left").where(F.col("held").isNull() | (100 * F.col("held").cast(WHOLE) < cover * F.col("f").cast(WHOLE)))

    counts = phrases.select("words", "f").unionByName(singles.select(F.array("key").alias("words"), "f"))
    cuts = free.join(totals, "lang").select("lang", "phrase", F.col("f").alias("a"), "n", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.withColumns({"head": F.slice("words", 1, F.col("cut")), "tail": F.slice("words", F.col("cut") + 1, size - F.col("cut"))})
    cuts = cuts.join(counts.select(F.col("words").alias("head"), F.col("f").alias("l")), "head") \
        .join(counts.select(F.col("words").alias("tail"), F.col("f").alias("r")), "tail")
    wide = {c: F.col(c).cast(WHOLE) for c in ("a", "n", "l", "r")}
    score = F.call_function("div", (wide["a"] * 1000) * wide["n"], wide["l"] * wide["r"])
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.select("lang", "phrase", "a", "n", "x.l", "x.r", "x.score").withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= first).select(F.col("lang").cast("string").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")
