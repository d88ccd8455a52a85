"""Tables of hashed keys that blocks of documents fill together and then consult.

Documents are dealt into blocks.  A block names its distinct keys, each once and with a number of its own;
keys are partitioned by hash into buckets, where the numbers of all blocks meet and one answer per key and
block is decided; the answers go back to the blocks.  So a key that every document holds costs one entry per
block, nothing is collected anywhere but a bucket's share of keys and a block's own texts, and both have a
size that the caller sets.  Keys travel packed, in rising order, some thousands to a row.

The texts are shuffled once: asking and finishing read the same exchange.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KeysOf = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]
Decide = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
Finish = Callable[[pa.Table, np.ndarray], pa.Table]


def bucket_bounds(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket's stretch of rising keys begins, and the end: buckets are ranges of equal width."""
    firsts = np.array([(b << 64) // n_buckets for b in range(1, n_buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, firsts), [len(keys)]])


def ask(blocked: DataFrame, block: str, n_buckets: int, keys_of: KeysOf, own: str, decide: Decide, answer: str,
        finish: Finish, schema: str) -> DataFrame:
    """finish(rows of a block, answers in the order of its rising keys) over all blocks.

    keys_of(rows) gives distinct rising uint64 keys and a number of type ``own`` for each;
    decide(keys, numbers, blocks) gets a bucket's entries and gives an answer of type ``answer`` to each.
    """
    def name(rows: pa.Table) -> pa.Table:
        keys, numbers = keys_of(rows)
        ends = bucket_bounds(keys, n_buckets)
        full = np.flatnonzero(np.diff(ends))
        packed = [(keys[ends[b] : ends[b + 1]].astype("<u8").tobytes(), numbers[ends[b] : ends[b + 1]].astype(own).tobytes())
                  for b in full]
        return pa.table({"bucket": pa.array(full.astype(np.int32)), "owner": pa.array([rows[block][0].as_py()] * len(full), pa.int32()),
                         "keys": pa.array([x for x, _ in packed], pa.binary()), "numbers": pa.array([x for _, x in packed], pa.binary())})

    def meet(rows: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_buffer(), "<u8") for x in rows["keys"]]
        numbers = [np.frombuffer(x.as_buffer(), own) for x in rows["numbers"]]
        owners = rows["owner"].to_numpy()
        sizes = np.array([len(x) for x in keys])
        answers = decide(np.concatenate(keys), np.concatenate(numbers), np.repeat(owners, sizes)).astype(answer)
        parts = np.split(answers, np.cumsum(sizes)[:-1])
        return pa.table({"owner": rows["owner"], "bucket": rows["bucket"], "answers": pa.array([x.tobytes() for x in parts], pa.binary())})

    def end(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({}).from_pylist([])
        ordered = answers.sort_by("bucket")["answers"]
        return finish(rows, np.concatenate([np.frombuffer(x.as_buffer(), answer) for x in ordered] or [np.zeros(0, answer)]))

    asked = blocked.groupBy(block).applyInArrow(name, "bucket int, owner int, keys binary, numbers binary")
    answered = asked.groupBy("bucket").applyInArrow(meet, "owner int, bucket int, answers binary")
    return blocked.groupBy(block).cogroup(answered.groupBy("owner")).applyInArrow(end, schema)
