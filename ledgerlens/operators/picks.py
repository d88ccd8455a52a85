"""Picking rows per key with a total order.

All picks go through ``row_number() <= n``, which Spark plans as a
WindowGroupLimit: every task keeps at most *n* rows per key before the shuffle,
so a key that holds a third of the table still sends only a few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def top_n(df: DataFrame, keys: Keys, order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first *n* rows of every key; ``rank`` names an output column for the position."""
    pos = rank or "__pos"
    ranked = df.withColumn(pos, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(pos) <= n)
    return kept if rank else kept.drop(pos)


def keep_one(df: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``.  Never leaves the choice to arrival order."""
    return top_n(df, keys, order, 1)


def as_of(df: DataFrame, key: str, date: str, on: Column) -> DataFrame:
    """The newest row of every key dated on or before ``on``; ``(key, date)`` must be unique.

    Fixed-width columns picked by date fit a hash aggregate, so the table is
    neither sorted nor shuffled: one row per key and task goes over the wire.
    """
    rest = [c for c in df.columns if c not in (key, date)]
    return (
        df.filter(F.col(date) <= on)
        .groupBy(key)
        .agg(F.max(date).alias(date), *[F.max_by(c, date).alias(c) for c in rest])
    )
