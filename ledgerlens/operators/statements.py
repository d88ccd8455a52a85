"""Point-in-time statement reads: histories, single quarters, trailing twelve months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import values as V
from ledgerlens.operators import picks

INCOME_FLOWS = ("total_revenue", "n_income_attr_p")
CASH_FLOWS = ("n_cashflow_act", "n_cashflow_inv_act", "c_pay_acq_const_fiolta")
SHOWN_QUARTERS = 8


# --- filters ---------------------------------------------------------------------


def visible(df: DataFrame, as_of: Column, f_ann: bool = True) -> DataFrame:
    """Rows public on ``as_of``; a row without any announcement date is never visible."""
    known = V.known_date("ann_date", "f_ann_date" if f_ann else None)
    return df.filter(known <= as_of)


def undated_rows(df: DataFrame) -> DataFrame:
    """How many rows per company no as-of read will ever see."""
    return (
        df.filter(V.known_date().isNull()).groupBy("ts_code").agg(F.count(F.lit(1)).alias("undated_rows"))
    )


def year_end(col: str = "end_date") -> Column:
    return (F.month(col) == 12) & (F.dayofmonth(col) == 31)


def cumulative() -> Column:
    """Cumulative statements, or statements whose type is unknown."""
    kind = V.statement_type("report_type")
    return kind.isNull() | (kind == "1")


def _newest_first(df: DataFrame, *tail: str) -> list[Column]:
    """Total order for 'newest': period, cumulative before unknown type, latest announcement."""
    order = [F.col("end_date").desc()]
    if "report_type" in df.columns:
        order.append(V.statement_type("report_type").asc_nulls_last())
    order.append(F.col("ann_date").desc_nulls_last())
    if "f_ann_date" in df.columns:
        order.append(F.col("f_ann_date").desc_nulls_last())
    return order + [F.col(c).desc_nulls_last() for c in tail]


# --- annual ----------------------------------------------------------------------


def annual_rows(income: DataFrame, as_of: Column) -> DataFrame:
    """Year-end cumulative income rows, one per stored key."""
    rows = visible(income, as_of).filter(year_end() & cumulative()).withColumn(
        "report_type", V.statement_type("report_type")
    )
    one = picks.keep_one(
        rows,
        ["ts_code", "end_date", "report_type"],
        [F.col("ann_date").desc_nulls_last(), F.col("f_ann_date").desc_nulls_last(),
         F.col("total_revenue").desc_nulls_last(), F.col("n_income_attr_p").desc_nulls_last()],
    )
    return one.withColumn("year", F.year("end_date"))


def growth(points: DataFrame, value: str, horizon: int = 5) -> list[Column]:
    """Aggregates over ``(year, value)``: full-span and exact-horizon growth of the positive points.

    To be used in one ``groupBy('ts_code').agg``; the end is the newest positive
    year, the horizon needs exactly that many years before it.
    """
    v = F.when(F.col(value) > 0, F.col(value))
    y = F.when(F.col(value) > 0, F.col("year"))
    return [
        F.min(y).alias(f"__{value}_y0"),
        F.max(y).alias(f"__{value}_y1"),
        F.min_by(v, y).alias(f"__{value}_v0"),
        F.max_by(v, y).alias(f"__{value}_v1"),
        F.collect_list(F.when(F.col(value) > 0, F.struct("year", v.alias("v")))).alias(f"__{value}_pts"),
    ]


def growth_columns(value: str, prefix: str, horizon: int = 5) -> list[Column]:
    y0, y1 = F.col(f"__{value}_y0"), F.col(f"__{value}_y1")
    v0, v1 = F.col(f"__{value}_v0"), F.col(f"__{value}_v1")
    base = F.filter(f"__{value}_pts", lambda p: p["year"] == y1 - horizon)
    back = F.when(F.size(base) > 0, F.element_at(base, 1)["v"])
    return [
        V.cagr_pct(v0, v1, y1 - y0).alias(f"{prefix}_cagr_full_pct"),
        V.cagr_pct(back, v1, F.lit(horizon)).alias(f"{prefix}_cagr_{horizon}y_pct"),
    ]


def annual_growth(income: DataFrame, as_of: Column, horizon: int = 5) -> DataFrame:
    """Growth of revenue and profit over the whole history and over the exact horizon."""
    rows = annual_rows(income, as_of)
    sums = rows.groupBy("ts_code").agg(
        F.count(F.lit(1)).alias("annual_count"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        *growth(rows, "total_revenue", horizon),
        *growth(rows, "n_income_attr_p", horizon),
    )
    return sums.select(
        "ts_code", "annual_count", "first_year", "last_year",
        *growth_columns("total_revenue", "revenue", horizon),
        *growth_columns("n_income_attr_p", "profit", horizon),
    )


def yearly_change(income: DataFrame, as_of: Column) -> DataFrame:
    """Newest annual row of every company with the change against the row before it."""
    two = picks.top_n(
        annual_rows(income, as_of), ["ts_code"],
        _newest_first(income, "total_revenue", "n_income_attr_p"), 2, rank="pos",
    )

    def at(pos: int, col: str) -> Column:
        return F.max(F.when(F.col("pos") == pos, F.col(col)))

    pair = two.groupBy("ts_code").agg(
        at(1, "year").alias("year"),
        at(1, "total_revenue").alias("revenue"),
        at(2, "total_revenue").alias("previous_revenue"),
        at(1, "n_income_attr_p").alias("net_profit"),
        at(2, "n_income_attr_p").alias("previous_net_profit"),
    )
    return pair.select(
        "*",
        V.yoy_pct("revenue", "previous_revenue").alias("revenue_yoy_pct"),
        V.yoy_pct("net_profit", "previous_net_profit").alias("net_profit_yoy_pct"),
    )


# --- quarters --------------------------------------------------------------------


def _period_values(prefix: str, flows: Sequence[str]) -> list[Column]:
    """Per period: the single-quarter row, the cumulative row and whether all types are blank."""
    mine = F.col("__src") == prefix
    kind = F.col("__kind")
    values = F.struct(*[F.col(c) for c in flows])
    rank = F.struct(F.col("ann_date"), F.col("f_ann_date"), *[F.col(c) for c in flows])
    return [
        F.max_by(values, F.when(mine & (kind == "2"), rank)).alias(f"{prefix}_direct"),
        F.max_by(values, F.when(mine & (kind == "1"), rank)).alias(f"{prefix}_typed"),
        F.max_by(values, F.when(mine & kind.isNull(), rank)).alias(f"{prefix}_blank"),
        F.bool_and(F.when(mine, kind.isNull())).alias(f"{prefix}_all_blank"),
        F.bool_or(mine).alias(f"{prefix}_here"),
    ]


def _choose_basis(df: DataFrame, prefix: str) -> DataFrame:
    """Cumulative basis of a period, and the label of where its value comes from."""
    direct, typed, blank = (F.col(f"{prefix}_{k}") for k in ("direct", "typed", "blank"))
    inferred = F.col(f"{prefix}_all_blank") & blank.isNotNull()
    return df.withColumns(
        {
            f"{prefix}_ytd": F.coalesce(typed, F.when(inferred, blank)),
            f"{prefix}_kind": F.when(~F.col(f"{prefix}_here"), F.lit(None).cast("string"))
            .when(direct.isNotNull(), "single_quarter")
            .when(typed.isNotNull(), "ytd")
            .when(inferred, "inferred_ytd")
            .otherwise("unknown"),
        }
    )


def _single_quarter(prefix: str, flow: str) -> Column:
    """Own single-quarter value first; Q1 is its own year-to-date; else the difference to the quarter before."""
    before = F.col(f"{prefix}_before")
    ytd = F.col(f"{prefix}_ytd.{flow}")
    step = F.when(before["q"] == F.col("quarter") - 1, ytd - before["ytd"][flow])
    return F.coalesce(
        F.col(f"{prefix}_direct.{flow}"),
        F.when(F.col("quarter") == 1, ytd).otherwise(step),
    )


def single_quarters(income: DataFrame, cashflow: DataFrame, as_of: Column) -> DataFrame:
    """Single-quarter values of both flow statements, one row per company and quarter end.

    Both statements travel in one frame, so choosing the basis and the full
    outer match of the periods are the same aggregate.  It combines map-side;
    after it a company has at most a few hundred rows, and one exchange by
    company serves every later step.
    """
    def tagged(df: DataFrame, src: str, flows: Sequence[str]) -> DataFrame:
        return visible(df, as_of).select(
            "ts_code", "end_date", "ann_date", "f_ann_date",
            V.statement_type("report_type").alias("__kind"),
            F.lit(src).alias("__src"),
            *[V.finite(c).alias(c) for c in flows],
        )

    both = tagged(income, "income", INCOME_FLOWS).unionByName(
        tagged(cashflow, "cashflow", CASH_FLOWS), allowMissingColumns=True
    )
    periods = (
        both.withColumn("quarter", V.quarter_no("end_date"))
        .filter(F.col("quarter").isNotNull())
        .groupBy("ts_code", "end_date", "quarter")
        .agg(*_period_values("income", INCOME_FLOWS), *_period_values("cashflow", CASH_FLOWS))
    )
    periods = _choose_basis(_choose_basis(periods, "income"), "cashflow")
    periods = periods.repartition("ts_code")
    earlier = (
        Window.partitionBy("ts_code", F.year("end_date"))
        .orderBy("quarter")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    for prefix in ("income", "cashflow"):
        ytd = F.col(f"{prefix}_ytd")
        mark = F.when(ytd.isNotNull(), F.struct(F.col("quarter").alias("q"), ytd.alias("ytd")))
        periods = periods.withColumn(f"{prefix}_before", F.last(mark, ignorenulls=True).over(earlier))
    return periods.select(
        "ts_code",
        "end_date",
        "quarter",
        F.col("income_kind"),
        F.col("cashflow_kind"),
        *[_single_quarter("income", f).alias(n) for f, n in zip(INCOME_FLOWS, ("revenue", "net_profit"))],
        *[_single_quarter("cashflow", f).alias(n)
          for f, n in zip(CASH_FLOWS, ("ocf", "investing_cashflow", "capex"))],
        F.col("income_ytd.total_revenue").alias("revenue_ytd"),
        F.col("income_ytd.n_income_attr_p").alias("net_profit_ytd"),
        F.col("cashflow_ytd.n_cashflow_act").alias("ocf_ytd"),
        F.col("cashflow_ytd.c_pay_acq_const_fiolta").alias("capex_ytd"),
    ).withColumns(
        {
            "fcf": V.free_cash_flow("ocf", "capex"),
            "fcf_ytd": V.free_cash_flow("ocf_ytd", "capex_ytd"),
        }
    )


def shown_quarters(quarters: DataFrame, n: int = SHOWN_QUARTERS) -> DataFrame:
    """The newest *n* quarters of every company, newest first (``pos`` = 1)."""
    return picks.top_n(quarters, ["ts_code"], [F.col("end_date").desc()], n, rank="pos")


def _quarter_id(period: Column) -> Column:
    return F.year(period["end_date"]) * 4 + period["quarter"]


def contiguous_four(periods: Column) -> Column:
    """The four newest quarters follow each other without a gap."""
    # ids are distinct and descending, so spanning three steps means no gap
    return F.when(
        F.size(periods) >= 4,
        _quarter_id(F.element_at(periods, 1)) - _quarter_id(F.element_at(periods, 4)) == 3,
    ).otherwise(False)


def four_quarter_sum(periods: Column, field: str) -> Column:
    """Sum of the newest four quarters; NULL when they have a gap or one value is unknown."""
    parts = V.strict_sum([F.try_element_at(periods, F.lit(i))[field] for i in (1, 2, 3, 4)])
    return F.when(contiguous_four(periods), parts)


def trailing_year(quarters: DataFrame) -> DataFrame:
    """Per company the shown quarters as an array and the trailing-twelve-month flows.

    A quarter whose basis was only inferred makes every trailing sum unusable.
    """
    shown = shown_quarters(quarters)
    fields = [c for c in shown.columns if c not in ("ts_code", "pos")]
    per_company = shown.groupBy("ts_code").agg(
        F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("periods")
    )
    inferred = F.exists(
        "periods",
        lambda p: F.coalesce(p["income_kind"] == "inferred_ytd", F.lit(False))
        | F.coalesce(p["cashflow_kind"] == "inferred_ytd", F.lit(False)),
    )
    p = F.col("periods")
    flows = per_company.withColumn("has_inferred", inferred).withColumns(
        {f"{f}_ttm": F.when(~F.col("has_inferred"), four_quarter_sum(p, f)) for f in ("ocf", "capex", "fcf")}
    )
    return flows.withColumns(
        {
            "period_count": F.size("periods"),
            "ocf_ttm_complete": F.col("ocf_ttm").isNotNull(),
            "ttm_complete": F.col("ocf_ttm").isNotNull()
            & F.col("capex_ttm").isNotNull()
            & F.col("fcf_ttm").isNotNull(),
        }
    )


# --- year-end histories ------------------------------------------------------------


def balance_history(balance: DataFrame, as_of: Column, years: int = 3) -> DataFrame:
    """Newest year-end balance sheets with debt and goodwill measures; one row per year."""
    rows = visible(balance, as_of).filter(year_end() & cumulative())
    one = picks.keep_one(rows, ["ts_code", "end_date"], _newest_first(rows, "total_assets"))
    top = picks.top_n(one, ["ts_code"], [F.col("end_date").desc()], years, rank="pos")
    debt = V.interest_debt()
    return top.select(
        "ts_code", "pos", "end_date",
        F.year("end_date").alias("year"),
        "total_assets",
        F.col("total_hldr_eqy_exc_min_int").alias("equity"),
        F.col("money_cap").alias("cash"),
        debt.alias("interest_debt"),
        (debt > F.col("money_cap")).alias("debt_gt_cash"),
        "goodwill", "accounts_receiv", "inventories",
        V.ratio_pct("goodwill", "total_hldr_eqy_exc_min_int").alias("goodwill_ratio_pct"),
        V.ratio_pct("total_liab", "total_assets").alias("asset_liability_ratio_pct"),
    )


def indicator_history(indicators: DataFrame, as_of: Column, years: int = 6) -> DataFrame:
    rows = visible(indicators, as_of, f_ann=False).filter(year_end())
    one = picks.keep_one(rows, ["ts_code", "end_date"], _newest_first(rows, "roe"))
    top = picks.top_n(one, ["ts_code"], [F.col("end_date").desc()], years, rank="pos")
    return top.select(
        "ts_code", "pos", F.year("end_date").alias("year"),
        V.finite("roe").alias("roe_pct"),
        V.finite("grossprofit_margin").alias("gross_margin_pct"),
        V.finite("netprofit_margin").alias("net_margin_pct"),
        V.finite("debt_to_assets").alias("debt_ratio_pct"),
        V.finite("current_ratio").alias("current_ratio"),
    )


def audit_history(audits: DataFrame, as_of: Column, rows: int = 3) -> DataFrame:
    seen = visible(audits, as_of, f_ann=False)
    one = picks.keep_one(seen, ["ts_code", "end_date"], _newest_first(seen, "audit_result"))
    return picks.top_n(one, ["ts_code"], [F.col("end_date").desc()], rows, rank="pos")


def forecast_history(forecasts: DataFrame, as_of: Column, rows: int = 3) -> DataFrame:
    seen = forecasts.filter(F.col("ann_date") <= as_of)
    order = [F.col("ann_date").desc(), F.col("end_date").desc_nulls_last(), F.col("type").asc_nulls_last(),
             F.col("net_profit_max").desc_nulls_last()]
    return picks.top_n(seen, ["ts_code"], order, rows, rank="pos")


def latest_market(daily_basic: DataFrame, as_of: Column) -> DataFrame:
    cols = ["ts_code", "trade_date", "close", "pe_ttm", "pb", "ps_ttm", "total_mv", "total_share"]
    return picks.as_of(daily_basic.select(*cols), "ts_code", "trade_date", as_of)
