"""Single quarters, trailing year, growth, as-of reads."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import picks
from ledgerlens.operators import statements as S
from ledgerlens.plans import company as C

INCOME = "ts_code string, ann_date date, f_ann_date date, end_date date, report_type string, total_revenue double, n_income_attr_p double"
CASH = "ts_code string, ann_date date, f_ann_date date, end_date date, report_type string, n_cashflow_act double, n_cashflow_inv_act double, c_pay_acq_const_fiolta double"
ENDS = {1: (3, 31), 2: (6, 30), 3: (9, 30), 4: (12, 31)}


def as_of():
    return F.lit("2026-06-15").cast("date")


def end(year, q):
    return dt.date(year, *ENDS[q])


def incomes(spark, rows, code="A"):
    """rows: (year, quarter, type, value)"""
    data = [(code, end(y, q), None, end(y, q), t, v, v) for y, q, t, v in rows]
    return spark.createDataFrame(data, INCOME)


def cash(spark, rows, code="A"):
    return spark.createDataFrame([(code, end(y, q), None, end(y, q), t, v, v, v / 2 if v is not None else None) for y, q, t, v in rows], CASH)


def singles(spark, rows):
    out = S.single_quarters(incomes(spark, rows), cash(spark, []), as_of()).orderBy("end_date").collect()
    return [(r.quarter, r.revenue, r.revenue_ytd, r.income_kind) for r in out]


def test_cumulative_to_single(spark):
    got = singles(spark, [(2025, 1, "1", 10.0), (2025, 2, "1", 25.0), (2025, 3, "1", 45.0), (2025, 4, "1", 70.0)])
    assert [r for _, r, _, _ in got] == [10.0, 15.0, 20.0, 25.0]
    assert got[3][2] == 70.0 and {k for *_, k in got} == {"ytd"}


def test_missing_quarter_breaks_the_chain(spark):
    assert singles(spark, [(2025, 1, "1", 10.0), (2025, 3, "1", 45.0)])[1][1] is None


def test_single_quarter_row_goes_first(spark):
    assert singles(spark, [(2025, 2, "2", 15.0)]) == [(2, 15.0, None, "single_quarter")]
    got = singles(spark, [(2025, 1, "1", 10.0), (2025, 2, "1", 25.0), (2025, 2, "2", 15.0), (2025, 3, "1", 45.0)])
    assert [(r, y) for _, r, y, _ in got] == [(10.0, 10.0), (15.0, 25.0), (20.0, 45.0)]


def test_a_single_quarter_only_period_does_not_break_the_chain(spark):
    got = singles(spark, [(2025, 1, "1", 10.0), (2025, 2, "2", 15.0), (2025, 3, "1", 45.0)])
    assert got[2][1] is None  # the year-to-date of quarter 2 is unknown
    got = singles(spark, [(2025, 1, "2", 10.0), (2025, 1, "1", 10.0), (2025, 2, "1", 25.0)])
    assert got[1][1] == 15.0


def test_unknown_types(spark):
    assert singles(spark, [(2025, 1, "3", 10.0), (2025, 2, "3", 15.0)]) == [(1, None, None, "unknown"), (2, None, None, "unknown")]
    assert [k for *_, k in singles(spark, [(2025, 1, "", 10.0), (2025, 2, None, 25.0)])] == ["inferred_ytd", "inferred_ytd"]
    assert singles(spark, [(2025, 1, None, 10.0), (2025, 1, "3", 11.0)])[0][3] == "unknown"


def ttm(spark, flows, income_rows=()):
    q = S.single_quarters(incomes(spark, income_rows), cash(spark, flows), as_of())
    return S.trailing_year(q).first()


def test_trailing_year(spark):
    four = [(2025, q, "2", float(v)) for q, v in ((1, 1), (2, 2), (3, 3), (4, 4))]
    row = ttm(spark, four)
    assert (row.ocf_ttm, row.capex_ttm, row.fcf_ttm, row.ttm_complete) == (10.0, 5.0, 5.0, True)
    gap = ttm(spark, [(2024, 4, "2", 1.0), *four[1:]])
    assert gap.ocf_ttm is None and not gap.ocf_ttm_complete
    unknown = ttm(spark, [*four[:3], (2025, 4, "2", None)])
    assert unknown.ocf_ttm is None


def test_inferred_basis_suppresses_the_trailing_year(spark):
    four = [(2025, q, "2", 1.0) for q in (1, 2, 3, 4)]
    assert ttm(spark, four, [(2025, 1, "", 5.0)]).ocf_ttm is None


def test_sum_before_rounding(spark):
    four = [(2025, q, "2", 150_400_000.0) for q in (1, 2, 3, 4)]
    t = {"income": incomes(spark, []), "cashflow": cash(spark, four)}
    assert C.quarterly(t, "2026-06-15").first().ocf_ttm_yi == 6.02


def test_sum_of_quarters_is_the_year(spark):
    rows = [(y, q, "1", float(y - 2000) * q * q) for y in (2023, 2024, 2025) for q in (1, 2, 3, 4)]
    out = S.single_quarters(incomes(spark, rows), cash(spark, []), as_of())
    per = out.groupBy(F.year("end_date").alias("y")).agg(F.sum("revenue").alias("s"), F.max("revenue_ytd").alias("t")).collect()
    assert len(per) == 3 and all(r.s == r.t for r in per)


def test_growth(spark):
    rows = [(2021, 4, "1", 100.0), (2023, 4, "1", 121.0)]
    r = S.annual_growth(incomes(spark, rows), as_of()).first()
    assert r.revenue_cagr_full_pct == pytest.approx(10.0) and r.revenue_cagr_5y_pct is None
    rows = [(2019, 4, "1", -5.0), (2020, 4, "1", 100.0), (2025, 4, "1", 200.0)]
    r = S.annual_growth(incomes(spark, rows), as_of()).first()
    assert r.revenue_cagr_5y_pct == pytest.approx((2 ** 0.2 - 1) * 100) == r.revenue_cagr_full_pct


def test_rows_without_announcement_are_invisible(spark):
    df = spark.createDataFrame([("A", None, None, end(2025, 4), "1", 1.0, 1.0), ("B", None, dt.date(2026, 7, 1), end(2025, 4), "1", 1.0, 1.0)], INCOME)
    assert S.annual_rows(df, as_of()).count() == 0
    assert [(r.ts_code, r.undated_rows) for r in S.undated_rows(df).collect()] == [("A", 1)]


def test_as_of(spark):
    df = spark.createDataFrame([("A", dt.date(2020, 1, 2), 10.0), ("A", dt.date(2026, 7, 30), 20.0)], "ts_code string, trade_date date, close double")
    row = picks.as_of(df, "ts_code", "trade_date", F.lit("2020-01-03").cast("date")).first()
    assert (row.trade_date, row.close) == (dt.date(2020, 1, 2), 10.0)


def test_interest_debt_is_unknown_with_one_part_unknown(spark):
    cols = "ts_code string, ann_date date, f_ann_date date, end_date date, report_type string, total_assets double, total_liab double, total_hldr_eqy_exc_min_int double, money_cap double, st_borr double, lt_borr double, bonds_payable double, goodwill double, accounts_receiv double, inventories double"
    d = end(2025, 4)
    df = spark.createDataFrame([("A", d, None, d, "1", 100.0, 40.0, 60.0, 5.0, 1.0, None, 2.0, 6.0, 1.0, 1.0), ("B", d, None, d, "", 100.0, 40.0, 0.0, 5.0, 4.0, 1.0, 2.0, 6.0, 1.0, 1.0)], cols)
    got = {r.ts_code: r for r in S.balance_history(df, as_of()).collect()}
    assert got["A"].interest_debt is None and got["A"].debt_gt_cash is None and got["A"].goodwill_ratio_pct == 10.0
    assert got["B"].interest_debt == 7.0 and got["B"].debt_gt_cash and got["B"].goodwill_ratio_pct is None
