"""Exact order statistics and peer comparison against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import orderstats, peers

DAY = dt.date(2026, 6, 12)


def test_bucket_is_monotone(spark):
    xs = sorted(random.Random(1).uniform(-1, 1) * 10 ** random.Random(i).randint(-12, 12) for i in range(2000)) + [0.0]
    df = spark.createDataFrame([(float(x),) for x in sorted(xs)], "x double")
    got = [r.b for r in df.select("x", orderstats.magnitude_bucket(F.col("x")).alias("b")).orderBy("x").collect()]
    assert got == sorted(got)


def test_cumulative_counts(spark):
    rng = random.Random(7)
    rows = [(g, float(rng.randint(-20, 20)) / 4, 1) for g in "ab" for _ in range(300)]
    counts = spark.createDataFrame(rows, "g string, x double, n int").groupBy("g", "x").agg(F.sum("n").alias("n"))
    got = orderstats.cumulative_counts(counts, ["g"], "x", ["n"]).collect()
    for r in got:
        xs = [x for g, x, _ in rows if g == r.g]
        assert (r.n_below, r.n_upto, r.n_total) == (sum(x < r.x for x in xs), sum(x <= r.x for x in xs), len(xs))


@pytest.mark.parametrize("least_parted", [0, 3, 40, 10**6])
def test_crowded_buckets_are_parted(spark, least_parted):
    """Values within one percent, within a millionth, of both signs and far apart rank alike however often buckets are parted."""
    rng = random.Random(8)
    spread = [lambda: rng.uniform(1, 1.005), lambda: 1.001 + rng.randint(0, 90) * 1e-9, lambda: -rng.uniform(1, 1.004), lambda: rng.uniform(-9e9, 9e9),
              lambda: 0.0, lambda: 5e-324 * rng.randint(1, 40)]
    rows = sorted({(g, rng.choice(spread)()) for g in "ab" for _ in range(500)})
    weights = {r: rng.randint(0, 3) for r in rows}
    counts = spark.createDataFrame([(g, x, n, 1) for (g, x), n in weights.items()], "g string, x double, n int, k int")
    got = orderstats.cumulative_counts(counts, ["g"], "x", ["n", "k"], least_parted)
    assert sorted(got.columns) == sorted(["g", "x", "n", "k", "n_below", "n_upto", "n_total", "k_below", "k_upto", "k_total"])
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        below = sum(n for (g, x), n in weights.items() if g == r.g and x < r.x)
        assert (r.n_below, r.n_upto, r.n_total) == (below, below + r.n, sum(n for (g, _), n in weights.items() if g == r.g))
        assert (r.k_below, r.k_upto) == (sum(g == r.g and x < r.x for g, x in rows), sum(g == r.g and x <= r.x for g, x in rows))


def make(spark, n, seed, industries=("X", "Y")):
    """Companies with ties, unknowns, outliers and some that may not be peers."""
    rng = random.Random(seed)
    stocks, ind, inc, daily = [], [], [], []
    for i in range(n):
        code = f"{i:06d}.SZ"
        name = "*ST a" if i % 11 == 3 else f"name {i}"
        stocks.append((code, name, None, rng.choice(industries)))
        if i % 7 != 2:
            value = lambda: None if rng.random() < 0.1 else float(rng.randint(1, 12))
            ind.append((code, dt.date(2026, 3, 1), dt.date(2025, 12, 31), value(), value(), value(), value()))
        inc.append((code, dt.date(2026, 3, 1), None, dt.date(2025, 12, 31), "1", 100.0, float(rng.randint(1, 9)), None if i % 5 == 0 else 2.0))
        pe = rng.choice([-3.0, 0.0, 8.0, 9.0, 10.0, 600.0, None])
        daily.append((code, DAY - dt.timedelta(days=i % 2), pe, float(rng.randint(1, 5)) * rng.choice([1, 200])))
        daily.append((code, DAY - dt.timedelta(days=1 + i % 2), 7.0, 3.0))
    return peers.PeerInputs(
        spark.createDataFrame(stocks, "ts_code string, name string, delist_date date, industry_sw string"),
        spark.createDataFrame(ind, "ts_code string, ann_date date, end_date date, roe double, grossprofit_margin double, netprofit_margin double, debt_to_assets double"),
        spark.createDataFrame(inc, "ts_code string, ann_date date, f_ann_date date, end_date date, report_type string, total_revenue double, sell_exp double, rd_exp double"),
        spark.createDataFrame(daily, "ts_code string, trade_date date, pe_ttm double, pb double"),
    ), stocks, ind, daily


def brute(stocks, values, code, trim_stats, trim_rank):
    """Statistics of everybody else in the industry that may be a peer."""
    industry = next(s[3] for s in stocks if s[0] == code)
    others = [values[s[0]] for s in stocks if s[3] == industry and s[0] != code and "ST" not in s[1] and values.get(s[0]) is not None]
    ok = lambda x: 0 < x < 500
    stats = [x for x in others if ok(x)] if trim_stats else others
    rank = [x for x in others if ok(x)] if trim_rank else others
    own = values.get(code)
    if not stats:
        return 0, None, None, None
    pct = None if own is None or not rank else 100 * sum(x <= own for x in rank) / len(rank)
    return len(stats), float(np.mean(stats)), [float(np.quantile(stats, q)) for q in (0.25, 0.5, 0.75)], pct


@pytest.mark.parametrize("n,seed,industries", [(60, 1, ("X", "Y")), (7, 2, ("X", "Y", "Z")), (2, 3, ("X",))])
def test_comparison_against_brute_force(spark, n, seed, industries):
    inputs, stocks, ind, daily = make(spark, n, seed, industries)
    got = {(r.ts_code, r.metric): r for r in peers.peer_comparison(inputs, F.lit("2026-06-15").cast("date")).collect()}
    roe = {r[0]: r[3] for r in ind}
    newest = {}
    for code, day, *_ in daily:
        newest[code] = max(day, newest.get(code, day))
    checked = 0
    for code, *_ in stocks:
        on_day = {c: (pe, pb) for c, d, pe, pb in daily if d == newest[code]}
        cases = {
            "roe_pct": brute(stocks, roe, code, False, False),
            "pe_ttm": brute(stocks, {c: v[0] for c, v in on_day.items()}, code, True, True),
            "pb": brute(stocks, {c: v[1] for c, v in on_day.items()}, code, True, False),
        }
        for metric, (count, mean, quantiles, pct) in cases.items():
            row = got.get((code, metric))
            if row is None:
                assert count == 0
                continue
            assert row.n == count
            if count:
                assert row.mean == pytest.approx(mean)
                assert [row.p25, row.median, row.p75] == pytest.approx(quantiles)
                assert (row.rank_pct is None) == (pct is None) and (pct is None or row.rank_pct == pytest.approx(pct))
                checked += 1
    assert checked or n < 5


def test_pool_statistics(spark):
    inputs, stocks, ind, _ = make(spark, 40, 5)
    got = {(r.industry, r.metric): r for r in peers.industry_stats(inputs, F.lit("2026-06-15").cast("date")).collect()}
    for industry in ("X", "Y"):
        xs = [r[3] for r in ind for s in stocks if s[0] == r[0] and s[3] == industry and "ST" not in s[1] and r[3] is not None]
        row = got[(industry, "roe_pct")]
        assert row.n == len(xs) and row.mean == pytest.approx(np.mean(xs))
        assert [row.p25, row.median, row.p75] == pytest.approx([np.quantile(xs, q) for q in (0.25, 0.5, 0.75)])
