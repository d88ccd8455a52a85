"""What a user asks about companies, answered for all companies at once.

Every function takes the canonical tables (name -> DataFrame) and an as-of date
and returns one row per company (or per company and period), in reporting units:
``_yi`` is 100 million yuan, ``_pct`` is percent, two decimals.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import values as V
from ledgerlens.operators import peers, picks
from ledgerlens.operators import statements as S

Tables = Mapping[str, DataFrame]


def day(d: date | str | Column) -> Column:
    return d if isinstance(d, Column) else F.to_date(F.lit(str(d)))


def stock_info(t: Tables) -> DataFrame:
    return t["stocks"].select(
        "ts_code", "name",
        F.coalesce(F.nullif("industry_sw", F.lit("")), F.lit("N/A")).alias("industry"),
        F.coalesce(V.ymd("list_date"), F.lit("N/A")).alias("list_date"),
        F.coalesce(F.nullif("area", F.lit("")), F.lit("N/A")).alias("area"),
    )


def market(t: Tables, as_of: date | str | Column) -> DataFrame:
    return S.latest_market(t["daily_basic"], day(as_of)).select(
        "ts_code",
        V.ymd("trade_date").alias("trade_date"),
        *[V.finite(c).alias(c) for c in ("close", "pe_ttm", "pb", "ps_ttm")],
        V.yi_from_wan("total_mv").alias("total_mv_yi"),
        V.finite("total_share").alias("total_shares_wan"),
        F.when(F.col("total_share") != 0, V.yi_from_wan("total_share")).alias("total_shares_yi"),
    )


def annual(t: Tables, as_of: date | str | Column) -> DataFrame:
    """Annual history, oldest first, with growth over the full span and over five years."""
    rows = S.annual_rows(t["income"], day(as_of))
    shown = rows.select(
        "ts_code",
        "year",
        V.finite("total_revenue").alias("total_revenue"),
        V.finite("n_income_attr_p").alias("n_income_attr_p"),
        F.struct(
            "year",
            V.yi("total_revenue").alias("revenue_yi"),
            V.yi("n_income_attr_p").alias("net_profit_yi"),
            V.pct("n_income_attr_p", "total_revenue").alias("net_margin_pct"),
            V.yi("rd_exp").alias("rd_expense_yi"),
            V.yi("sell_exp").alias("sell_expense_yi"),
            V.yi("operate_profit").alias("operate_profit_yi"),
            V.yi("non_oper_income").alias("non_oper_income_yi"),
            V.pct("non_oper_income", "operate_profit").alias("non_recurring_pct"),
        ).alias("row"),
    )
    per = shown.groupBy("ts_code").agg(
        F.array_sort(F.collect_list("row")).alias("annual_data"),
        *S.growth(shown, "total_revenue"),
        *S.growth(shown, "n_income_attr_p"),
    )
    rates = S.growth_columns("total_revenue", "revenue") + S.growth_columns("n_income_attr_p", "profit")
    names = ["revenue_cagr_full_pct", "revenue_cagr_5y_pct", "profit_cagr_full_pct", "profit_cagr_5y_pct"]
    return per.select(
        "ts_code",
        "annual_data",
        F.size("annual_data").alias("count"),
        F.element_at("annual_data", 1)["year"].alias("first_year"),
        F.element_at("annual_data", -1)["year"].alias("last_year"),
        *[V.rounded(c).alias(n) for c, n in zip(rates, names)],
    )


def quarterly(t: Tables, as_of: date | str | Column) -> DataFrame:
    """Newest eight single quarters and the trailing twelve months."""
    ttm = S.trailing_year(S.single_quarters(t["income"], t["cashflow"], day(as_of)))

    def shown(p: Column) -> Column:
        return F.struct(
            V.ymd(p["end_date"]).alias("period"),
            p["quarter"].alias("quarter"),
            F.lit("standalone_quarter").alias("period_kind"),
            F.struct(
                p["income_kind"].alias("income"), p["cashflow_kind"].alias("cashflow")
            ).alias("source_statement_kind"),
            (p["quarter"] == 1).alias("is_q1"),
            (p["quarter"] == 4).alias("is_annual"),
            *[V.yi(p[c]).alias(f"{c}_yi") for c in (
                "revenue_ytd", "net_profit_ytd", "ocf_ytd", "capex_ytd", "fcf_ytd",
                "revenue", "net_profit", "ocf", "investing_cashflow", "capex", "fcf")],
            V.pct(p["ocf"], p["net_profit"]).alias("ocf_ratio_pct"),
        )

    return ttm.select(
        "ts_code",
        F.transform("periods", shown).alias("periods"),
        "period_count",
        "has_inferred",
        "ocf_ttm_complete",
        "ttm_complete",
        V.yi("fcf_ttm").alias("fcf_ttm_yi"),
        V.yi("ocf_ttm").alias("ocf_ttm_yi"),
        V.yi("capex_ttm").alias("cap_ex_ttm_yi"),
    )


def _history(rows: DataFrame, fields: list[Column], name: str) -> DataFrame:
    """Ranked rows (``pos``) -> one array per company, newest first."""
    packed = rows.select("ts_code", F.struct("pos", *fields).alias("__r"))
    return packed.groupBy("ts_code").agg(F.array_sort(F.collect_list("__r")).alias(name))


def balance(t: Tables, as_of: date | str | Column) -> DataFrame:
    rows = S.balance_history(t["balance"], day(as_of))
    fields = [
        V.ymd("end_date").alias("end_date"), F.col("year"),
        *[V.yi(c).alias(f"{c}_yi") for c in ("total_assets", "equity", "cash", "interest_debt")],
        F.col("debt_gt_cash"),
        V.yi("goodwill").alias("goodwill_yi"),
        V.rounded("goodwill_ratio_pct").alias("goodwill_ratio_pct"),
        V.yi("accounts_receiv").alias("accounts_receiv_yi"),
        V.yi("inventories").alias("inventories_yi"),
        V.rounded("asset_liability_ratio_pct").alias("asset_liability_ratio_pct"),
    ]
    hist = _history(rows, fields, "balance_history")
    # the newest year is repeated at the top level
    top = F.element_at("balance_history", 1)
    names = ("end_date", "year", "total_assets_yi", "equity_yi", "cash_yi", "interest_debt_yi", "debt_gt_cash",
             "goodwill_yi", "goodwill_ratio_pct", "accounts_receiv_yi", "inventories_yi",
             "asset_liability_ratio_pct")
    return hist.select("ts_code", *[top[n].alias(n) for n in names],
                       F.transform("balance_history", lambda r: r.dropFields("pos", "end_date")).alias("balance_history"))


def indicators(t: Tables, as_of: date | str | Column) -> DataFrame:
    rows = S.indicator_history(t["fina_indicators"], day(as_of))
    names = ("year", "roe_pct", "gross_margin_pct", "net_margin_pct", "debt_ratio_pct", "current_ratio")
    hist = _history(rows, [F.col(n) for n in names], "indicators")
    return hist.select(
        "ts_code",
        F.transform("indicators", lambda r: r.dropFields("pos")).alias("indicators"),
        F.size("indicators").alias("count"),
    )


def audit(t: Tables, as_of: date | str | Column) -> DataFrame:
    rows = S.audit_history(t["fina_audit"], day(as_of))
    fields = [
        V.ymd("ann_date").alias("ann_date"), V.ymd("end_date").alias("end_date"),
        F.col("audit_result"), F.col("audit_sign"), V.yi("audit_fees").alias("audit_fees_yi"), F.col("audit_agency"),
    ]
    hist = _history(rows, fields, "history")
    return hist.select(
        "ts_code",
        F.transform("history", lambda r: r.dropFields("pos")).alias("history"),
    ).withColumns({"latest": F.element_at("history", 1), "has_audit": F.lit(True)})


def forecast(t: Tables, as_of: date | str | Column) -> DataFrame:
    rows = S.forecast_history(t["forecast"], day(as_of))
    fields = [
        V.ymd("ann_date").alias("ann_date"), V.ymd("end_date").alias("period_end"), F.col("type"),
        V.yi_from_wan("net_profit_min").alias("net_profit_min_yi"),
        V.yi_from_wan("net_profit_max").alias("net_profit_max_yi"),
        V.yi_from_wan("last_parent_net").alias("last_period_profit_yi"),
        V.finite("p_change_min").alias("p_change_min_pct"),
        V.finite("p_change_max").alias("p_change_max_pct"),
        F.col("summary"),
    ]
    hist = _history(rows, fields, "forecasts")
    return hist.select(
        "ts_code",
        F.transform("forecasts", lambda r: r.dropFields("pos")).alias("forecasts"),
        F.lit(True).alias("has_forecast"),
    )


def peer_inputs(t: Tables) -> peers.PeerInputs:
    return peers.PeerInputs(t["stocks"], t["fina_indicators"], t["income"], t["daily_basic"])


def industry(t: Tables, as_of: date | str | Column, trim_rank: bool = False) -> DataFrame:
    """Peer comparison per company: statistics and own rank of every measure, and coverage counts."""
    on = day(as_of)
    src = peer_inputs(t)
    values = peers.measures(src, on)
    rows = peers.peer_comparison(src, on, trim_rank, stored=values)
    stats = F.struct(
        F.col("n").cast("int").alias("count"),
        *[V.rounded(c).alias(c) for c in ("mean", "median", "p25", "p75")],
    )
    # at most eight measures per company
    per = rows.groupBy("ts_code").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("metric", stats.alias("stats")))))
        ).alias("industry_stats"),
        F.map_from_entries(
            F.array_sort(F.flatten(F.collect_list(F.when(F.col("value").isNotNull(), F.array(
                F.struct(F.col("metric").alias("k"), F.col("value").alias("v")),
                F.struct(F.concat("metric", F.lit("_rank_pct")).alias("k"), V.rounded("rank_pct").alias("v")),
            )))))
        ).alias("target"),
    )
    cover = peers.peer_coverage(src, on, stored=values)
    return cover.join(per, "ts_code", "left").select(
        "ts_code",
        "industry",
        "peer_count",
        V.fiscal_year_available(on).alias("comparison_fiscal_year"),
        V.ymd("trade_date").alias("comparison_trade_date"),
        "financial_peer_rows",
        "market_peer_rows",
        "target",
        F.when(F.col("peer_count") > 0, F.col("industry_stats")).alias("industry_stats"),
    )


# --- macro -----------------------------------------------------------------------


def macro_latest(macro: DataFrame) -> DataFrame:
    """Newest reading of each macro series and the direction over its last three readings.

    A missing reading stays missing; zero is a value.
    """
    known = macro.filter(F.col("period").isNotNull())
    last3 = picks.top_n(known, ["indicator"], [F.col("period").desc()], 3, rank="pos")

    def at(pos: int, col: str) -> Column:
        return F.max(F.when(F.col("pos") == pos, F.col(col)))

    per = last3.groupBy("indicator").agg(
        at(1, "period").alias("period"),
        at(1, "value").alias("value"),
        at(1, "yoy_pct").alias("yoy_pct"),
        at(3, "value").alias("oldest"),
        F.count("value").alias("readings"),
    )
    step = F.col("value") - F.col("oldest")
    return per.select(
        "indicator", "period", "value", "yoy_pct",
        F.when(F.col("indicator").startswith("pmi"), V.pmi_band("value")).alias("band"),
        F.when((F.col("readings") == 3) & (step > 0), "up")
        .when((F.col("readings") == 3) & (step < 0), "down")
        .when((F.col("readings") == 3) & (step == 0), "flat").alias("direction"),
    )


def money_gap(macro: DataFrame, m1: str = "m1", m2: str = "m2") -> DataFrame:
    """M1 growth minus M2 growth per period, with its label."""
    def series(name: str) -> Column:
        return F.max(F.when(F.col("indicator") == name, F.col("yoy_pct")))

    per = macro.filter(F.col("indicator").isin(m1, m2)).groupBy("period").agg(
        series(m1).alias("m1_yoy_pct"), series(m2).alias("m2_yoy_pct")
    )
    gap = F.round(F.col("m1_yoy_pct") - F.col("m2_yoy_pct"), 2)
    return per.select("*", gap.alias("gap_pct"), V.money_gap_band(gap).alias("band"))


def macro_snapshot(macro: DataFrame, historical: bool = False) -> DataFrame:
    """All series, newest first.  A historical as-of must not see current macro data: nothing comes out."""
    rows = macro.filter(F.lit(not historical))
    return rows.groupBy("indicator").agg(
        F.max_by(F.struct("period", "value", "yoy_pct"), "period").alias("latest"),
        F.count(F.lit(1)).alias("points"),
    )


# --- composed --------------------------------------------------------------------


def overview(t: Tables, as_of: date | str | Column) -> DataFrame:
    """The figures at the top of a report: newest year with change, growth, ratios, peers."""
    on = day(as_of)
    change = S.yearly_change(t["income"], on)
    growth = S.annual_growth(t["income"], on).drop("annual_count", "first_year", "last_year")
    bal = S.balance_history(t["balance"], on, 1).select("ts_code", "cash", "interest_debt")
    ind = S.indicator_history(t["fina_indicators"], on, 1).select(
        "ts_code", "roe_pct", "gross_margin_pct", "net_margin_pct", "debt_ratio_pct"
    )
    mkt = S.latest_market(t["daily_basic"], on).select("ts_code", "trade_date", "close", "pe_ttm", "pb", "total_mv")
    base = t["stocks"].select("ts_code", "name", F.col("industry_sw").alias("industry"))
    out = base
    for part in (mkt, change, growth, ind, bal):
        out = out.join(part, "ts_code", "left")
    return out


def overview_peers(t: Tables, as_of: date | str | Column) -> DataFrame:
    """Own value, peer median, rank and sample size of the eight measures."""
    rows = peers.peer_comparison(peer_inputs(t), day(as_of))
    return rows.filter("n > 0 and value is not null").select("ts_code", "metric", "value", "median", "rank_pct", "n")


def freshness(t: Tables, as_of: date | str | Column, days: int = 7) -> DataFrame:
    """Is the newest valuation at most ``days`` old."""
    on = day(as_of)
    newest = t["daily_basic"].filter(F.col("trade_date") <= on).groupBy("ts_code").agg(F.max("trade_date").alias("trade_date"))
    age = F.datediff(on, F.col("trade_date"))
    joined = t["stocks"].select("ts_code").join(newest, "ts_code", "left")
    return joined.select(
        "ts_code", V.ymd("trade_date").alias("trade_date"), age.alias("age_days"),
        F.coalesce(age <= days, F.lit(False)).alias("fresh"),
    )
