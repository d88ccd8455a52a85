"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

Words are runs of characters other than ASCII white space, A to Z in lower case.  Each n-gram up to
``order`` words is counted over all documents in tables that are partitioned by hash; the n-grams of each
document are joined to their counts and their scores summed.  So that a document does not vouch for itself,
its own occurrences are taken off first:

    S(w | h) = c(h w) / c(h)           if c(h w) > 0
             = alpha * S(w | h')       otherwise, h' being h without its first word
    S(w)     = c(w) / N                c(w) = 0 counts as one half

where c counts in the other documents and N is their number of words.  log_score is the sum of ln S over the
words of the document, per_word its mean.

Null and empty texts have no words, log_score 0 and no per_word; if no other document has a word, N counts
as 1.  Each repeated row is a document of its own, so copies vouch for each other.  Hashes have 64 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import blocks, materialize, text_bytes
from ledgerlens.llm.exchange import ask
from ledgerlens.llm.words import ngram_hashes, word_hashes

ORDER = 2
ALPHA = 0.4
UNSEEN = 0.5
BLOCK_BYTES = 8_000_000
BUCKET_BYTES = 16_000_000
SUMS = "doc_id long, n_words long, n_backoffs long, n_alone long, partial double"
SUM_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_backoffs", pa.int64()), ("n_alone", pa.int64()), ("partial", pa.float64())]


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES,
          bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_backoffs, log_score, per_word of every document."""
    n_buckets = max(1, math.ceil(order * text_bytes(docs) / 2 / bucket_bytes))

    def keys_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        grams = ngram_hashes(*word_hashes(rows["text"].to_pylist()), order)
        return np.unique(np.concatenate([h for _, h in grams]), return_counts=True)

    def decide(keys: np.ndarray, counts: np.ndarray, _: np.ndarray) -> np.ndarray:
        _, of = np.unique(keys, return_inverse=True)
        return np.bincount(of, counts).astype(np.int64)[of]

    def finish(rows: pa.Table, totals: np.ndarray) -> pa.Table:
        words, of = word_hashes(rows["text"].to_pylist())
        grams = ngram_hashes(words, of, order)
        keys = np.unique(np.concatenate([h for _, h in grams]))
        size, n = len(words), len(rows)
        others = []  # for n = 1, ...: how often other documents hold the n-gram that ends at each place
        for places, hashes in grams:
            at = np.searchsorted(keys, hashes)
            _, pair, times = np.unique(of[places] * len(keys) + at, return_inverse=True, return_counts=True)
            held = np.full(size, -1, np.int64)
            held[places] = totals[at] - times[pair]
            others.append(held)
        value, backoffs = np.zeros(size), np.zeros(size, np.int64)
        open_ = np.ones(size, bool)
        for k in range(order - 1, 0, -1):
            has = open_ & (others[k] > 0)
            at = np.flatnonzero(has)
            value[at] += np.log(others[k][at] / others[k - 1][at - 1])
            open_ &= ~has
            backoffs += open_ & (others[k] == 0)
        value += backoffs * math.log(alpha)
        value[open_] += np.log(np.where(others[0][open_] > 0, others[0][open_], UNSEEN)) if size else 0.0
        sums = [np.bincount(of, x, n) for x in (np.ones(size), backoffs, open_, value)]
        return pa.table([rows["doc_id"].combine_chunks().cast(pa.int64()), *(pa.array(x.astype(np.int64)) for x in sums[:3]), pa.array(sums[3])],
                        schema=pa.schema(SUM_FIELDS))

    blocked = blocks(docs, block_bytes)
    sums = materialize(ask(blocked, "block", n_buckets, keys_of, "<i8", decide, "<i8", finish, SUMS), "backoff-sums")
    total = sums.agg(F.sum("n_words").alias("n")).first().n or 0
    rest = F.greatest(F.lit(1), F.lit(total) - F.col("n_words"))
    log_score = F.col("partial") - F.col("n_alone") * F.log(rest.cast("double"))
    return sums.select("doc_id", "n_words", "n_backoffs", log_score.alias("log_score"),
                       F.when(F.col("n_words") > 0, log_score / F.col("n_words")).alias("per_word"))
