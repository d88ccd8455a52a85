"""Scalar rules, with literal vectors."""

import math

from pyspark.sql import functions as F

from ledgerlens.functions import values as V


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in cols.items())
    df = spark.createDataFrame([tuple(cols.values())], schema) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_finite_and_strict_sum(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("inf",), ("-Infinity",), ("--",), (None,)], "v string")
    assert [r.x for r in df.select(V.finite("v").alias("x")).collect()] == [1.5] + [None] * 5
    sums = spark.createDataFrame([(1.0, None, 2.0), (1.0, 0.0, 2.0)], "a double, b double, c double")
    assert [r.x for r in sums.select(V.strict_sum(["a", "b", "c"]).alias("x")).collect()] == [None, 3.0]


def test_vendor_numbers(spark):
    assert one(spark, V.wan_from_yuan("a"), a="123,450,000") == 12345.0
    assert one(spark, V.wan_from_yuan("a"), a="--") is None
    assert one(spark, V.vendor_number("a"), a="24.62%") == 24.62


def test_units_and_ratios(spark):
    assert one(spark, V.yi("a"), a=4 * 150_400_000.0) == 6.02
    assert one(spark, V.yi_from_wan("a"), a=12345.0) == 1.23
    assert one(spark, V.pct("a", "b"), a=1.0, b=0.0) is None
    assert one(spark, V.pct("a", "b"), a=1.0, b=8.0) == 12.5
    assert one(spark, V.yoy_pct("a", "b"), a=120.0, b=100.0) == (120 / 100 - 1) * 100


def test_growth_needs_positive_ends(spark):
    rate = V.cagr_pct(F.col("a"), F.col("b"), F.lit(2))
    assert math.isclose(one(spark, rate, a=100.0, b=121.0), 10.0)
    assert one(spark, rate, a=-1.0, b=121.0) is None
    assert one(spark, V.cagr_pct(F.col("a"), F.col("b"), F.lit(0)), a=100.0, b=121.0) is None


def test_dates(spark):
    assert one(spark, V.compact_date("a"), a="2026-07-30") == "20260730"
    assert one(spark, V.hyphen_date("a"), a="2026/07/30") == "2026-07-30"
    assert one(spark, V.as_date("a"), a="") is None
    assert one(spark, V.as_date("a"), a="20260231") is None
    df = spark.sql("select date'2026-03-31' a, date'2026-03-30' b, date'2026-12-31' c, date'2026-04-30' d, date'2026-05-01' e")
    r = df.select(*[V.quarter_no(x).alias(x) for x in "abc"], *[V.fiscal_year_available(F.col(x)).alias(x) for x in "de"]).first()
    assert tuple(r) == (1, None, 4, 2024, 2025)


def test_codes(spark):
    rows = [("600519", "600519.SH"), ("000001.sz", "000001.SZ"), (" 430047 ", "430047.BJ"), ("700000", None), ("60051", None), (None, None)]
    df = spark.createDataFrame(rows, "v string, want string")
    assert all(r.x == r.want for r in df.select("want", V.normalize_code("v").alias("x")).collect())
    assert one(spark, V.code_exchange("a"), a="600519.SH") == "SH"


def test_labels_and_units_of_paths(spark):
    paths = {
        "market.total_mv_yi": "亿", "market.total_shares_wan": "万", "industry.industry_stats.roe_pct.count": "",
        "annual.revenue_cagr_5y_pct": "%", "quarterly.period_count": "", "market.close": "", "industry.target.pe_ttm_rank_pct": "%",
    }
    df = spark.createDataFrame(list(paths.items()), "p string, want string")
    assert all(r.x == r.want for r in df.select("want", V.infer_unit("p").alias("x")).collect())
    bands = spark.createDataFrame([(52.0,), (50.0,), (48.0,), (47.9,), (None,)], "v double")
    assert [r.x for r in bands.select(V.pmi_band("v").alias("x")).collect()] == [
        "expansion_strong", "expansion_mild", "contraction_edge", "contraction_weak", None]
    gaps = spark.createDataFrame([(-5.1,), (-5.0,), (-2.0,), (2.0,), (2.1,)], "v double")
    assert [r.x for r in gaps.select(V.money_gap_band("v").alias("x")).collect()] == [
        "very_low_activity", "low_activity", "normal", "normal", "high_activity"]


def test_display_precision(spark):
    rows = [(101.0, 100.9, "101亿", True), (100.0, 100.9, "100亿", False), (0.0, 0.0, "0", True), (1.23, 1.2349, "1.23", True), (1.23, 1.236, "1.23", False)]
    df = spark.createDataFrame(rows, "p double, s double, raw string, want boolean")
    got = df.select("want", V.display_equal(F.col("p"), F.col("s"), V.shown_decimals("raw")).alias("x")).collect()
    assert all(r.x == r.want for r in got)


def test_cjk(spark):
    assert one(spark, V.cjk_count("a"), a="中文ab，12字") == 3


def test_whole_cents_are_those_of_round(spark):
    from pyspark.sql import functions as F

    from ledgerlens.bindings import proxy

    df = spark.createDataFrame([(x,) for x in (0.0, 0.07, 1.15, 12345.67, 90049.99, -0.07, -901.25, 0.005, -0.005, 2.5, None)], "x double")
    one = df.select(proxy._whole(F.col("x") * 100).alias("got"), F.round(F.col("x") * 100).cast("bigint").alias("want"))
    assert one.schema["got"].dataType == one.schema["want"].dataType and all(r.got == r.want for r in one.collect())
