"""Vendor frames -> canonical tables: renaming, cleaning, merging, replacing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import schema
from ledgerlens.functions import values as V
from ledgerlens.operators import picks

# Statement headings of the second vendor and the canonical names.
INCOME_HEADINGS = {
    "营业总收入": "total_revenue",
    "营业收入": "revenue",
    "营业总成本": "total_cogs",
    "销售费用": "sell_exp",
    "管理费用": "admin_exp",
    "财务费用": "fin_exp",
    "研发费用": "rd_exp",
    "营业利润": "operate_profit",
    "利润总额": "total_profit",
    "净利润": "n_income",
    "归属于母公司股东的净利润": "n_income_attr_p",
    "营业外收入": "non_oper_income",
}
BALANCE_HEADINGS = {
    "资产总计": "total_assets",
    "负债合计": "total_liab",
    "所有者权益(或股东权益)合计": "total_hldr_eqy_inc_min_int",
    "归属于母公司所有者权益合计": "total_hldr_eqy_exc_min_int",
    "货币资金": "money_cap",
    "交易性金融资产": "trad_asset",
    "应收票据": "notes_receiv",
    "应收账款": "accounts_receiv",
    "存货": "inventories",
    "商誉": "goodwill",
    "无形资产": "intan_assets",
    "固定资产": "fix_assets",
    "短期借款": "st_borr",
    "长期借款": "lt_borr",
    "应付债券": "bonds_payable",
    "非流动资产合计": "total_nca",
    "流动负债合计": "total_cur_liab",
    "非流动负债合计": "total_noncur_liab",
    "实收资本(或股本)": "total_share",
}
CASHFLOW_HEADINGS = {
    "经营活动产生的现金流量净额": "n_cashflow_act",
    "投资活动产生的现金流量净额": "n_cashflow_inv_act",
    "筹资活动产生的现金流量净额": "n_cash_flows_fnc_act",
    "期末现金及现金等价物余额": "c_cash_equ_end_period",
    "购建固定资产、无形资产和其他长期资产支付的现金": "c_pay_acq_const_fiolta",
    "购建固定资产、无形资产及其他长期资产支付的现金": "c_pay_acq_const_fiolta",
}
INDICATOR_HEADINGS = {
    "净资产收益率": "roe",
    "净资产收益率-摊薄": "roe_dt",
    "销售毛利率": "grossprofit_margin",
    "销售净利率": "netprofit_margin",
    "营业总收入同比增长率": "tr_yoy",
    "净利润同比增长率": "netprofit_yoy",
    "资产负债率": "debt_to_assets",
    "流动比率": "current_ratio",
    "速动比率": "quick_ratio",
    "每股经营现金流": "ocf_to_profit",
}
QUOTE_HEADINGS = {
    "开盘": "open",
    "收盘": "close",
    "最高": "high",
    "最低": "low",
    "成交量": "vol",
    "成交额": "amount",
    "涨跌幅": "pct_chg",
    "涨跌额": "change",
}
COMPANY_ITEMS = {
    "股票简称": "name",
    "公司名称": "fullname",
    "上市时间": "list_date",
    "行业": "industry_sw",
    "地域": "area",
}
DATE_HEADINGS = ("报告日", "日期", "报告期")
# Column names of older data sets and the canonical ones.
RENAMES = {"free_cashflow": "free_cash_flow", "industry": "industry_sw"}
LEGACY_COLUMNS = {"audit_result": "opinion_type", "audit_fees": "audit_costs"}


# --- columns -------------------------------------------------------------------


def harmonize(df: DataFrame, headings: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Vendor headings -> canonical numeric columns; what does not parse is NULL.

    Two headings may name the same column; the first one present wins per row.
    """
    sources: dict[str, list[str]] = {}
    for heading, name in headings.items():
        if heading in df.columns:
            sources.setdefault(name, []).append(heading)
    numbers = [
        F.coalesce(*[V.vendor_number(F.col(f"`{h}`")) for h in hs]).alias(name)
        for name, hs in sources.items()
    ]
    return df.select(*keep, *numbers)


def find_date_column(df: DataFrame, headings: Sequence[str] = DATE_HEADINGS) -> str | None:
    """The column that carries the period: by its heading, else the first column if it looks like one.

    It does if every value that is not blank is a date of eight digits; the driver sees that one answer.
    """
    for name in df.columns:
        if any(h in name for h in headings):
            return name
    first = df.columns[0]
    value = F.regexp_replace(F.trim(F.col(f"`{first}`").cast("string")), "-", "")
    all_dates = df.agg(F.bool_and(F.when(value != "", value.rlike(r"^\d{8}$"))).alias("ok")).first().ok
    return first if all_dates else None


def dated_between(df: DataFrame, date_column: str, start: Column, end: Column) -> DataFrame:
    """Parse the period column as ``end_date`` and keep the asked range."""
    return (
        df.withColumn("end_date", V.as_date(F.col(f"`{date_column}`")))
        .filter(F.col("end_date").between(start, end))
    )


def rename(df: DataFrame, names: Mapping[str, str] = RENAMES) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def carry_legacy(df: DataFrame, legacy: Mapping[str, str] = LEGACY_COLUMNS) -> DataFrame:
    """Fill a new column from the name it used to have."""
    out = df
    for new, old in legacy.items():
        if old in out.columns:
            filled = F.coalesce(F.col(new), F.col(old)) if new in out.columns else F.col(old)
            out = out.withColumn(new, filled)
    return out


def add_missing(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    return df.withColumns(
        {name: F.lit(None).cast(kind) for name, kind in columns.items() if name not in df.columns}
    )


def company_row(pairs: DataFrame, items: Mapping[str, str] = COMPANY_ITEMS) -> DataFrame:
    """Long (ts_code, item, value) -> one row per company.

    The item list is fixed, so this is one aggregate with map-side combine.
    """
    picked = [
        F.max(F.when(F.col("item") == item, F.col("value"))).alias(name) for item, name in items.items()
    ]
    return pairs.groupBy("ts_code").agg(*picked)


def companies_from_quotes(quotes: DataFrame, code: str, name: str) -> DataFrame:
    """Market-wide quote list -> company dimension; keeps six-character symbols with a known exchange."""
    symbol = F.col(code).cast("string")
    listed = quotes.filter(F.length(symbol) == 6).select(
        V.normalize_code(symbol).alias("ts_code"), symbol.alias("symbol"), F.col(name).alias("name")
    )
    return listed.filter("ts_code is not null").withColumn("exchange", V.code_exchange("ts_code"))


def date_quote_snapshot(
    snapshot: DataFrame, quotes: DataFrame, captured_at: Column, wanted: Column
) -> DataFrame:
    """Undated market snapshot -> valuation rows stamped with the newest real trade date.

    A snapshot speaks only for the day it was taken, and on a weekday only
    after 16:00; otherwise nothing comes out.  A company without a quote in the
    two weeks before gives no row.
    """
    day = F.to_date(captured_at)
    weekend = F.dayofweek(day).isin(1, 7)
    usable = snapshot.filter((wanted == day) & (weekend | (F.hour(captured_at) >= 16)))
    recent = quotes.filter(F.col("trade_date").between(F.date_sub(day, 14), day))
    stamp = (
        recent.groupBy("ts_code")
        .agg(F.max(F.struct("trade_date", "close")).alias("q"))
        .select("ts_code", "q.trade_date", "q.close")
    )
    return usable.drop("trade_date", "close").join(stamp, "ts_code")


# --- rows ----------------------------------------------------------------------


def keep_last(df: DataFrame, keys: Sequence[str], arrival: Sequence[Column]) -> DataFrame:
    """Of rows with the same key, the one that arrived last (``arrival`` ascending)."""
    return picks.keep_one(df, keys, [a.desc_nulls_last() for a in arrival])


def upsert(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], arrival: Sequence[Column]
) -> DataFrame:
    """Incoming rows replace stored rows with the same key; the rest stays.

    The stored side only passes an anti join, so a small daily batch leaves the
    big table unshuffled.
    """
    fresh = keep_last(incoming, keys, arrival)
    kept = existing.join(fresh.select(*keys), list(keys), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def replace_companies(
    existing: DataFrame, incoming: DataFrame, dedup: Sequence[str], arrival: Sequence[Column], by: Sequence[str] = ("ts_code",)
) -> DataFrame:
    """Everything stored for the incoming keys ``by`` goes; the deduplicated input takes its place."""
    kept = existing.join(incoming.select(*by).distinct(), list(by), "left_anti")
    fresh = keep_last(incoming, dedup, arrival)
    return kept.unionByName(fresh, allowMissingColumns=True)


def refresh_companies(incoming: DataFrame, arrival: Sequence[Column]) -> DataFrame:
    """Full replacement of the company dimension; an empty input is refused, not written."""
    if incoming.isEmpty():
        raise ValueError("empty company list: the stored dimension stays as it is")
    return keep_last(incoming, ["ts_code"], arrival)


def first_source(
    sources: Mapping[str, DataFrame], by: Sequence[str]
) -> DataFrame:
    """Per key, all rows of the first source that has any; sources never blend.

    Each later source contributes only the keys the earlier ones lack.
    """
    merged: DataFrame | None = None
    for name, frame in sources.items():
        tagged = frame.withColumn("source", F.lit(name))
        if merged is None:
            merged = tagged
        else:
            missing = tagged.join(merged.select(*by).distinct(), list(by), "left_anti")
            merged = merged.unionByName(missing, allowMissingColumns=True)
    if merged is None:
        raise ValueError("no source given")
    return merged


def best_text(sources: Mapping[str, DataFrame], by: Sequence[str], section: str = "section_name") -> DataFrame:
    """Text with a fallback chain: per report the sections of the best-ranked source only."""
    tagged = None
    for rank, (name, frame) in enumerate(sources.items()):
        part = frame.withColumns({"source": F.lit(name), "__rank": F.lit(rank)})
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    if tagged is None:
        raise ValueError("no source given")
    best = tagged.groupBy(*by).agg(F.min("__rank").alias("__best"))
    return tagged.join(best, list(by)).filter("__rank = __best").drop("__rank", "__best")


# --- planning --------------------------------------------------------------------


def sync_plan(companies: DataFrame, daily_basic: DataFrame, income: DataFrame, as_of: Column) -> DataFrame:
    """Per company and table group: is it stale, and from which day must it be fetched again."""
    last_trade = daily_basic.groupBy("ts_code").agg(F.max("trade_date").alias("last_trade"))
    last_period = income.groupBy("ts_code").agg(F.max("end_date").alias("last_period"))
    known = companies.select("ts_code").join(last_trade, "ts_code", "left").join(last_period, "ts_code", "left")
    ten_years = F.date_sub(as_of, 3650)

    def stale(last: str, days: int) -> Column:
        return F.col(last).isNull() | (F.datediff(as_of, F.col(last)) > days)

    return known.select(
        "ts_code",
        "last_trade",
        "last_period",
        stale("last_trade", 1).alias("daily_stale"),
        stale("last_period", 120).alias("statements_stale"),
        F.when(stale("last_trade", 1), F.coalesce("last_trade", ten_years)).alias("daily_from"),
        F.when(stale("last_period", 120), ten_years).alias("statements_from"),
    )


STATEMENT_TABLES = ("income", "balance", "cashflow", "fina_indicators", "fina_audit")


def statement_gate(fetched: Mapping[str, DataFrame]) -> DataFrame:
    """Companies for which all five statement tables arrived, and what the others miss."""
    tags = None
    for i, table in enumerate(STATEMENT_TABLES):
        part = fetched[table].groupBy("ts_code").agg(F.count(F.lit(1)).alias("rows"))
        part = part.select("ts_code", F.lit(table).alias("table"), "rows")
        tags = part if tags is None else tags.unionByName(part)
    have = [F.max(F.when(F.col("table") == t, True)).alias(t) for t in STATEMENT_TABLES]
    seen = tags.groupBy("ts_code").agg(*have, F.sum("rows").alias("rows"))
    missing = F.array_compact(F.array(*[F.when(F.col(t).isNull(), F.lit(t)) for t in STATEMENT_TABLES]))
    return seen.select(
        "ts_code",
        "rows",
        (F.size(missing) == 0).alias("complete"),
        F.array_join(missing, ",").alias("missing"),
    )


def rows_written(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table and company of what is about to be written."""
    counts = None
    for name, frame in tables.items():
        part = frame.groupBy("ts_code").agg(F.count(F.lit(1)).alias("rows_written"))
        part = part.select(F.lit(name).alias("table_name"), "ts_code", "rows_written")
        counts = part if counts is None else counts.unionByName(part)
    if counts is None:
        raise ValueError("no table given")
    return counts


def usable_sections(reports: DataFrame, min_section: int = 200, min_year: int = 1000) -> DataFrame:
    """Sections with enough text, in years that have enough text altogether."""
    size = F.length(F.trim(F.coalesce("section_text", F.lit(""))))
    long_enough = reports.filter(size >= min_section)
    per_year = (
        long_enough.groupBy("ts_code", "report_year")
        .agg(F.sum(F.length("section_text")).alias("year_chars"))
        .filter(F.col("year_chars") >= min_year)
    )
    return long_enough.join(per_year, ["ts_code", "report_year"])


def loaded_years(reports: DataFrame, min_section: int = 200, min_year: int = 1000) -> DataFrame:
    """Years with usable text; only lengths travel, never the text."""
    size = F.length(F.trim(F.coalesce("section_text", F.lit(""))))
    return (
        reports.filter(size >= min_section)
        .groupBy("ts_code", "report_year")
        .agg(F.sum(F.length("section_text")).alias("year_chars"))
        .filter(F.col("year_chars") >= min_year)
        .select("ts_code", "report_year")
    )


def text_gaps(companies: DataFrame, loaded: DataFrame, fiscal_year: Column, years: int = 5, enough: int = 3) -> DataFrame:
    """Report years that still have to be fetched.

    Newest first: the newest year is always asked for; an older gap only while
    fewer than ``enough`` years are there, counting what the plan itself adds.
    """
    window = F.sequence(fiscal_year - (years - 1), fiscal_year)
    have = loaded.groupBy("ts_code").agg(F.collect_set("report_year").alias("have"))
    plan = companies.select("ts_code").join(have, "ts_code", "left").withColumn(
        "have", F.array_intersect(F.coalesce("have", F.array().cast("array<int>")), window)
    )
    gaps = F.reverse(F.array_sort(F.array_except(window, F.col("have"))))
    # The k-th gap (0-based) is reached with size(have) + k years in hand.
    wanted = F.filter(
        gaps, lambda y: (y == fiscal_year) | (F.size("have") + F.array_position(gaps, y) - 1 < enough)
    )
    return plan.select("ts_code", F.explode(wanted).alias("report_year"))
