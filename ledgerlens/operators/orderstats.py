"""Exact ranks and order statistics per group, without putting a group in one task.

``percentile`` keeps every distinct value of a group in one buffer, and a window
over the group sorts it in one task; both fail when one group holds a third of
the table.  Here equal values are counted first (map-side) and values are then
spread over buckets by magnitude.  A bucket with many distinct values, as of an
industry whose values lie within one percent, is parted into finer ones, and
again where that is not enough.  Ranks follow from the tree of counts: no window
sees more than the buckets of one level, a number bounded by the floating point
range and not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets per power of two: one bucket spans about one percent of its value.
BUCKETS_PER_OCTAVE = 64
#: Bits by which a bucket with too many distinct values is parted, twice at most.
FINER_BITS = (12, 16)
#: Distinct values that one task puts in order before their bucket is parted.
LEAST_PARTED = 100_000


def magnitude_bucket(x: Column, per_octave: int = BUCKETS_PER_OCTAVE) -> Column:
    """Integer that never decreases with ``x``; equal magnitudes of opposite sign mirror around zero."""
    # |x| >= 2^-1074, so the shifted exponent stays positive
    size = F.floor(F.log2(F.abs(x)) * per_octave).cast("long") + F.lit(2048 * per_octave)
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("int") * size)


def cumulative_counts(
    counts: DataFrame, group: Sequence[str], value: str, weights: Sequence[str], least_parted: int = LEAST_PARTED
) -> DataFrame:
    """Running totals of ``weights`` along ``value`` within every group.

    ``counts`` holds one row per (group, value).  Adds for every weight *w*
    ``w_below`` (total at smaller values), ``w_upto`` (including this value) and
    ``w_total`` (the whole group).  Buckets of more than ``least_parted`` values
    are parted; where there are none, the joins with their parts fall away at run time.
    """
    group = list(group)
    first, second = FINER_BITS
    finest = magnitude_bucket(F.col(value), BUCKETS_PER_OCTAVE << (first + second))
    located = counts.withColumn("__fine", finest).withColumns(
        {"__mid": F.shiftright("__fine", second), "__coarse": F.shiftright("__fine", first + second)}
    )

    def totals(frame: DataFrame, level: list[str], n: Column) -> DataFrame:
        return frame.groupBy(*group, *level).agg(n.alias("__n"), *[F.sum(w).alias(w) for w in weights])

    def along(frame: DataFrame, within: list[str], level: str, name: str) -> DataFrame:
        """What lies before each bucket of ``level`` in the same bucket of ``within``."""
        before = Window.partitionBy(*group, *within).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumns({f"__{w}_{name}": F.coalesce(F.sum(w).over(before), F.lit(0)) for w in weights})

    mid = totals(located, ["__coarse", "__mid"], F.count("*"))
    coarse = along(totals(mid, ["__coarse"], F.sum("__n")), [], "__coarse", "base")
    whole = Window.partitionBy(*group)
    base = coarse.select(
        *group, "__coarse", *[f"__{w}_base" for w in weights], *[F.sum(w).over(whole).alias(f"{w}_total") for w in weights]
    )
    busy = F.col("__n") > least_parted
    crowded = coarse.where(busy).select(*group, "__coarse")
    parts = along(mid.join(crowded, [*group, "__coarse"], "left_semi"), ["__coarse"], "__mid", "part")
    tight = parts.where(busy).select(*group, "__mid")
    bits = along(totals(located.join(tight, [*group, "__mid"], "left_semi"), ["__mid", "__fine"], F.count("*")), ["__mid"], "__fine", "bit")
    # a value belongs to the finest bucket that was formed around it
    placed = (
        located.join(parts.select(*group, "__mid", *[f"__{w}_part" for w in weights]), [*group, "__mid"], "left")
        .join(bits.select(*group, "__fine", *[f"__{w}_bit" for w in weights]), [*group, "__fine"], "left")
    )
    probe = weights[0]
    bucket = F.when(F.col(f"__{probe}_bit").isNotNull(), F.col("__fine")).when(
        F.col(f"__{probe}_part").isNotNull(), F.shiftleft("__mid", second)).otherwise(F.shiftleft("__coarse", first + second))
    placed = placed.withColumn("__bucket", bucket)
    inside = (
        Window.partitionBy(*group, "__coarse", "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = placed.withColumns({f"__{w}_run": F.sum(w).over(inside) for w in weights})
    joined = running.join(base, [*group, "__coarse"])
    for w in weights:
        earlier = [F.coalesce(F.col(f"__{w}_{k}"), F.lit(0)) for k in ("part", "bit")]
        joined = joined.withColumn(f"{w}_upto", F.col(f"__{w}_base") + earlier[0] + earlier[1] + F.col(f"__{w}_run"))
        joined = joined.withColumn(f"{w}_below", F.col(f"{w}_upto") - F.col(w))
    return joined.drop("__bucket", "__coarse", "__mid", "__fine",
                       *[f"__{w}_{k}" for w in weights for k in ("base", "part", "bit", "run")])


def group_constants(
    ranked: DataFrame, group: Sequence[str], value: str, weight: str, positions: dict[str, Column]
) -> DataFrame:
    """One row per group: size, sum, and the value at each 0-based position of the sorted group.

    A position outside the group gives NULL; ``positions`` may refer to
    ``<weight>_total``.  One aggregate with map-side combine.
    """
    below, upto = F.col(f"{weight}_below"), F.col(f"{weight}_upto")
    at = [
        F.max(F.when((p >= below) & (p < upto), F.col(value))).alias(name) for name, p in positions.items()
    ]
    return (
        ranked.filter(F.col(weight) > 0)
        .groupBy(*group)
        .agg(
            F.max(f"{weight}_total").alias(f"{weight}_total"),
            F.sum(F.col(value) * F.col(weight)).alias(f"{weight}_sum"),
            *at,
        )
    )


def interpolate(low: Column, high: Column, h: Column) -> Column:
    """Linear interpolation between the values below and above the fractional position ``h``."""
    part = h - F.floor(h)
    return F.when(part == 0, low).otherwise(low + (high - low) * part)
