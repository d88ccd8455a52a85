"""Registered queries: statements, market, peers, quality - and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.bindings import proxy
from ledgerlens.bindings.sqltables import AS_OF, FY, sql
from ledgerlens.bindings.staging import StagedTables
from ledgerlens.functions import values as V
from ledgerlens.operators import peers, quality
from ledgerlens.operators import statements as S
from ledgerlens.plans import company as C
from ledgerlens.plans import snapshot
from ledgerlens.sources import ingest
from ledgerlens.sources import tables as src

DAY = proxy.AS_OF
QUERIES = {}
ORACLE = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return register


def _tables(spark: SparkSession, sf_dir: str):
    return proxy.tables(spark, sf_dir)


def _on():
    return C.day(DAY)


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round computed doubles for comparison; far finer than any reported figure."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def r6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c.split('.')[-1]}" for c in cols)


@query("stock_info", sql("SELECT ts_code, name, industry, 'N/A' AS list_date, area FROM stocks", "stocks"))
def stock_info(spark, sf_dir):
    return C.stock_info(_tables(spark, sf_dir))


@query("latest_market", sql(f"""SELECT ts_code, strftime(trade_date, '%Y%m%d') AS trade_date, {r6('close', 'pe_ttm', 'pb', 'ps_ttm')},
 round(total_mv / 1e4, 2) AS total_mv_yi, total_share AS total_shares_wan, round(total_share / 1e4, 2) AS total_shares_yi FROM mkt""", "mkt"))
def latest_market(spark, sf_dir):
    return _r(C.market(_tables(spark, sf_dir), DAY), "close", "pe_ttm", "pb", "ps_ttm")


@query("annual_history", sql(f"""SELECT ts_code, y AS year, round(total_revenue / 1e8, 2) AS revenue_yi,
 round(n_income_attr_p / 1e8, 2) AS net_profit_yi, round(n_income_attr_p / nullif(total_revenue, 0) * 100, 2) AS net_margin_pct,
 round(rd_exp / 1e8, 2) AS rd_expense_yi, round(sell_exp / 1e8, 2) AS sell_expense_yi,
 round(operate_profit / 1e8, 2) AS operate_profit_yi, round(non_oper_income / 1e8, 2) AS non_oper_income_yi,
 round(non_oper_income / nullif(operate_profit, 0) * 100, 2) AS non_recurring_pct FROM annual""", "annual"))
def annual_history(spark, sf_dir):
    return C.annual(_tables(spark, sf_dir), DAY).select("ts_code", F.inline("annual_data"))


_RATES = ("revenue_cagr_full_pct", "revenue_cagr_5y_pct", "profit_cagr_full_pct", "profit_cagr_5y_pct")


@query("annual_growth", sql(f"SELECT ts_code, annual_count, first_year, last_year, {r6(*_RATES)} FROM rates", "rates"))
def annual_growth(spark, sf_dir):
    return _r(S.annual_growth(_tables(spark, sf_dir)["income"], _on()), *_RATES)


@query("yearly_change", sql("""SELECT ts_code, max(y) FILTER (pos = 1) AS year, max(total_revenue) FILTER (pos = 1) AS revenue,
 max(total_revenue) FILTER (pos = 2) AS previous_revenue, max(n_income_attr_p) FILTER (pos = 1) AS net_profit,
 max(n_income_attr_p) FILTER (pos = 2) AS previous_net_profit,
 round((max(total_revenue) FILTER (pos = 1) / nullif(max(total_revenue) FILTER (pos = 2), 0) - 1) * 100, 6) AS revenue_yoy_pct,
 round((max(n_income_attr_p) FILTER (pos = 1) / nullif(max(n_income_attr_p) FILTER (pos = 2), 0) - 1) * 100, 6) AS net_profit_yoy_pct
 FROM (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY end_date DESC) AS pos FROM annual) GROUP BY ts_code""", "annual"))
def yearly_change(spark, sf_dir):
    return _r(S.yearly_change(_tables(spark, sf_dir)["income"], _on()), "revenue_yoy_pct", "net_profit_yoy_pct")


_SQ = ("quarter", "income_kind", "cashflow_kind", "revenue", "net_profit", "ocf", "investing_cashflow", "capex",
       "revenue_ytd", "net_profit_ytd", "ocf_ytd", "capex_ytd", "fcf", "fcf_ytd")


@query("single_quarters", sql(f"SELECT ts_code, strftime(end_date, '%Y%m%d') AS end_date, {', '.join(_SQ)} FROM sq", "sq"))
def single_quarters(spark, sf_dir):
    t = _tables(spark, sf_dir)
    q = S.single_quarters(t["income"], t["cashflow"], _on())
    return q.select("ts_code", V.ymd("end_date").alias("end_date"), *_SQ)


@query("ttm_cashflow", sql("""SELECT ts_code, period_count, has_inferred,
 CASE WHEN contiguous AND NOT has_inferred THEN ocf4 END AS ocf_ttm, CASE WHEN contiguous AND NOT has_inferred THEN capex4 END AS capex_ttm,
 CASE WHEN contiguous AND NOT has_inferred THEN fcf4 END AS fcf_ttm,
 contiguous AND NOT has_inferred AND ocf4 IS NOT NULL AS ocf_ttm_complete,
 contiguous AND NOT has_inferred AND ocf4 IS NOT NULL AND capex4 IS NOT NULL AND fcf4 IS NOT NULL AS ttm_complete FROM ttm""", "ttm"))
def ttm_cashflow(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return S.trailing_year(S.single_quarters(t["income"], t["cashflow"], _on())).drop("periods")


@query("quarterly_report", sql("""SELECT ts_code, strftime(end_date, '%Y%m%d') AS period, quarter, quarter = 1 AS is_q1,
 round(revenue / 1e8, 2) AS revenue_yi, round(net_profit / 1e8, 2) AS net_profit_yi, round(ocf / 1e8, 2) AS ocf_yi,
 round(fcf / 1e8, 2) AS fcf_yi, round(fcf_ytd / 1e8, 2) AS fcf_ytd_yi, round(ocf / nullif(net_profit, 0) * 100, 2) AS ocf_ratio_pct FROM shown""", "shown"))
def quarterly_report(spark, sf_dir):
    rows = C.quarterly(_tables(spark, sf_dir), DAY).select("ts_code", F.inline("periods"))
    return rows.select("ts_code", "period", "quarter", "is_q1", "revenue_yi", "net_profit_yi", "ocf_yi", "fcf_yi",
                       "fcf_ytd_yi", "ocf_ratio_pct")


@query("balance_history", sql("""SELECT ts_code, pos, year(end_date) AS year, total_assets, equity, money_cap AS cash, debt AS interest_debt,
 debt > money_cap AS debt_gt_cash, goodwill, accounts_receiv, inventories,
 round(goodwill / nullif(equity, 0) * 100, 6) AS goodwill_ratio_pct,
 round(total_liab / nullif(total_assets, 0) * 100, 6) AS asset_liability_ratio_pct FROM bal3""", "bal3"))
def balance_history(spark, sf_dir):
    df = S.balance_history(_tables(spark, sf_dir)["balance"], _on()).drop("end_date")
    return _r(df, "goodwill_ratio_pct", "asset_liability_ratio_pct")


@query("balance_report", sql("""SELECT ts_code, strftime(end_date, '%Y%m%d') AS end_date, round(total_assets / 1e8, 2) AS total_assets_yi,
 round(equity / 1e8, 2) AS equity_yi, round(debt / 1e8, 2) AS interest_debt_yi, round(goodwill / 1e8, 2) AS goodwill_yi,
 round(goodwill / nullif(equity, 0) * 100, 2) AS goodwill_ratio_pct FROM bal3 WHERE pos = 1""", "bal3"))
def balance_report(spark, sf_dir):
    return C.balance(_tables(spark, sf_dir), DAY).select(
        "ts_code", "end_date", "total_assets_yi", "equity_yi", "interest_debt_yi", "goodwill_yi", "goodwill_ratio_pct")


_IND = ("roe_pct", "gross_margin_pct", "net_margin_pct", "debt_ratio_pct", "current_ratio")


@query("indicator_history", sql("""SELECT ts_code, pos, year(end_date) AS year, round(roe, 6) AS roe_pct, round(gross, 6) AS gross_margin_pct,
 round(net, 6) AS net_margin_pct, round(debt, 6) AS debt_ratio_pct, round(cur, 6) AS current_ratio FROM ind6""", "ind6"))
def indicator_history(spark, sf_dir):
    return _r(S.indicator_history(_tables(spark, sf_dir)["fina_indicators"], _on()), *_IND)


@query("audit_history", sql("""SELECT ts_code, pos, strftime(ann_date, '%Y%m%d') AS ann_date, strftime(end_date, '%Y%m%d') AS end_date,
 audit_result, audit_agency, round(audit_fees / 1e8, 2) AS audit_fees_yi FROM aud3""", "aud3"))
def audit_history(spark, sf_dir):
    df = S.audit_history(_tables(spark, sf_dir)["fina_audit"], _on())
    return df.select("ts_code", "pos", V.ymd("ann_date").alias("ann_date"), V.ymd("end_date").alias("end_date"),
                     "audit_result", "audit_agency", V.yi("audit_fees").alias("audit_fees_yi"))


@query("forecast_history", sql("""SELECT ts_code, strftime(ann_date, '%Y%m%d') AS ann_date, strftime(end_date, '%Y%m%d') AS period_end, type,
 round(net_profit_min / 1e4, 2) AS net_profit_min_yi, round(net_profit_max / 1e4, 2) AS net_profit_max_yi,
 round(last_parent_net / 1e4, 2) AS last_period_profit_yi, p_change_min AS p_change_min_pct, p_change_max AS p_change_max_pct, summary FROM fc3""", "fc3"))
def forecast_history(spark, sf_dir):
    return C.forecast(_tables(spark, sf_dir), DAY).select("ts_code", F.inline("forecasts"))


# --- peers -------------------------------------------------------------------------

_CMP = ("value", "mean", "p25", "median", "p75", "rank_pct")


@query("peer_comparison", sql(f"""SELECT ts_code, industry, strftime(period, '%Y%m%d') AS period, metric, n, {r6(*_CMP)} FROM cmp""", "cmp"))
def peer_comparison(spark, sf_dir):
    df = peers.peer_comparison(C.peer_inputs(_tables(spark, sf_dir)), _on())
    return _r(df.withColumn("period", V.ymd("period")), *_CMP)


@query("peer_stats", sql("""SELECT industry, strftime(period, '%Y%m%d') AS period, metric, count(*) AS n, round(avg(x), 6) AS mean,
 round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS p75
 FROM pool WHERE in_stats GROUP BY ALL""", "pool"))
def peer_stats(spark, sf_dir):
    df = peers.industry_stats(C.peer_inputs(_tables(spark, sf_dir)), _on())
    return _r(df.withColumn("period", V.ymd("period")), "mean", "p25", "median", "p75")


@query("peer_rank_trimmed", sql("""SELECT t.ts_code, t.metric, round(CASE WHEN t.x IS NOT NULL AND count(p.x) FILTER (p.in_stats) > 0 THEN
 100.0::DOUBLE * count(p.x) FILTER (p.in_stats AND p.x <= t.x) / nullif(count(p.x) FILTER (p.in_stats), 0) END, 6) AS rank_pct
 FROM target t LEFT JOIN pool p ON p.industry = t.industry AND p.period = t.period AND p.metric = t.metric AND p.ts_code <> t.ts_code
 GROUP BY t.ts_code, t.industry, t.period, t.metric, t.x HAVING t.x IS NOT NULL OR count(p.x) FILTER (p.in_stats) > 0""", "target", "pool"))
def peer_rank_trimmed(spark, sf_dir):
    df = peers.peer_comparison(C.peer_inputs(_tables(spark, sf_dir)), _on(), trim_rank=True)
    return _r(df.select("ts_code", "metric", "rank_pct"), "rank_pct")


@query("peer_coverage", sql("""SELECT f.ts_code, f.industry, strftime(o.trade_date, '%Y%m%d') AS trade_date,
 (SELECT count(*) FROM firms p WHERE p.industry = f.industry AND p.in_pool AND p.ts_code <> f.ts_code) AS peer_count,
 (SELECT count(*) FROM fin p WHERE p.industry = f.industry AND p.in_pool AND p.ts_code <> f.ts_code
   AND coalesce(roe_pct, gross_margin_pct, net_margin_pct, debt_ratio_pct) IS NOT NULL) AS financial_peer_rows,
 (SELECT count(*) FROM val p WHERE p.industry = f.industry AND p.in_pool AND p.ts_code <> f.ts_code
   AND p.trade_date = o.trade_date AND coalesce(pe_ttm, pb) IS NOT NULL) AS market_peer_rows
 FROM firms f LEFT JOIN own_date o ON o.ts_code = f.ts_code""", "firms", "own_date", "fin", "val"))
def peer_coverage(spark, sf_dir):
    df = peers.peer_coverage(C.peer_inputs(_tables(spark, sf_dir)), _on())
    return df.withColumn("trade_date", V.ymd("trade_date"))


# --- composed ----------------------------------------------------------------------

_OV = ("close", "pe_ttm", "pb", "revenue_yoy_pct", "net_profit_yoy_pct", "revenue_cagr_5y_pct", "profit_cagr_5y_pct",
       "roe_pct", "gross_margin_pct", "debt_ratio_pct")


@query("overview", sql(f"""SELECT s.ts_code, s.name, s.industry, strftime(m.trade_date, '%Y%m%d') AS trade_date, m.total_mv,
 c.y AS year, b.money_cap AS cash, b.debt AS interest_debt, {r6('m.close', 'm.pe_ttm', 'm.pb')},
 round((c.total_revenue / nullif(c.prev_rev, 0) - 1) * 100, 6) AS revenue_yoy_pct,
 round((c.n_income_attr_p / nullif(c.prev_np, 0) - 1) * 100, 6) AS net_profit_yoy_pct,
 {r6('r.revenue_cagr_5y_pct', 'r.profit_cagr_5y_pct')}, round(i.roe, 6) AS roe_pct, round(i.gross, 6) AS gross_margin_pct, round(i.debt, 6) AS debt_ratio_pct
 FROM stocks s LEFT JOIN mkt m ON m.ts_code = s.ts_code LEFT JOIN rates r ON r.ts_code = s.ts_code
 LEFT JOIN (SELECT *, lag(total_revenue) OVER w AS prev_rev, lag(n_income_attr_p) OVER w AS prev_np,
   row_number() OVER (PARTITION BY ts_code ORDER BY end_date DESC) AS pos FROM annual
   WINDOW w AS (PARTITION BY ts_code ORDER BY end_date)) c ON c.ts_code = s.ts_code AND c.pos = 1
 LEFT JOIN bal3 b ON b.ts_code = s.ts_code AND b.pos = 1 LEFT JOIN ind6 i ON i.ts_code = s.ts_code AND i.pos = 1""",
 "stocks", "mkt", "rates", "annual", "bal3", "ind6"))
def overview(spark, sf_dir):
    df = C.overview(_tables(spark, sf_dir), DAY)
    df = df.select("ts_code", "name", "industry", V.ymd("trade_date").alias("trade_date"), "total_mv", "year", "cash",
                   "interest_debt", *_OV)
    return _r(df, *_OV)


@query("overview_peers", sql("""SELECT ts_code, metric, round(value, 6) AS value, round(median, 6) AS median,
 round(rank_pct, 6) AS rank_pct, n FROM cmp WHERE n > 0 AND value IS NOT NULL""", "cmp"))
def overview_peers(spark, sf_dir):
    return _r(C.overview_peers(_tables(spark, sf_dir), DAY), "value", "median", "rank_pct")


@query("data_freshness", sql(f"""SELECT s.ts_code, strftime(m.trade_date, '%Y%m%d') AS trade_date, date_diff('day', m.trade_date, {AS_OF}) AS age_days,
 coalesce(date_diff('day', m.trade_date, {AS_OF}) <= 7, false) AS fresh FROM stocks s LEFT JOIN mkt m ON m.ts_code = s.ts_code""", "stocks", "mkt"))
def data_freshness(spark, sf_dir):
    return C.freshness(_tables(spark, sf_dir), DAY)


@query("undated_rows", sql("""SELECT ts_code, count(*) AS undated_rows FROM income WHERE ann_date IS NULL AND f_ann_date IS NULL GROUP BY 1""", "income"))
def undated_rows(spark, sf_dir):
    return S.undated_rows(_tables(spark, sf_dir)["income"])


# --- macro -------------------------------------------------------------------------


@query("macro_latest", sql("""SELECT indicator, max(period) FILTER (pos = 1) AS period, round(max(value) FILTER (pos = 1), 6) AS value,
 round(max(value / 3) FILTER (pos = 1), 6) AS yoy_pct,
 CASE WHEN indicator LIKE 'pmi%' THEN CASE WHEN max(value) FILTER (pos = 1) >= 52 THEN 'expansion_strong'
  WHEN max(value) FILTER (pos = 1) >= 50 THEN 'expansion_mild' WHEN max(value) FILTER (pos = 1) >= 48 THEN 'contraction_edge'
  ELSE 'contraction_weak' END END AS band,
 CASE WHEN count(*) < 3 THEN NULL WHEN max(value) FILTER (pos = 1) > max(value) FILTER (pos = 3) THEN 'up'
  WHEN max(value) FILTER (pos = 1) < max(value) FILTER (pos = 3) THEN 'down' ELSE 'flat' END AS direction
 FROM (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY period DESC) AS pos FROM macro QUALIFY pos <= 3) GROUP BY indicator""", "macro"))
def macro_latest(spark, sf_dir):
    return _r(C.macro_latest(_tables(spark, sf_dir)["macro"]), "value", "yoy_pct")


@query("money_gap", sql("""SELECT period, round(m1, 6) AS m1_yoy_pct, round(m2, 6) AS m2_yoy_pct, round(m1 - m2, 2) AS gap_pct,
 CASE WHEN round(m1 - m2, 2) < -5 THEN 'very_low_activity' WHEN round(m1 - m2, 2) < -2 THEN 'low_activity'
  WHEN round(m1 - m2, 2) > 2 THEN 'high_activity' WHEN m1 - m2 IS NOT NULL THEN 'normal' END AS band
 FROM (SELECT period, max(value / 3) FILTER (indicator = 'm1') AS m1, max(value / 3) FILTER (indicator = 'm2') AS m2
 FROM macro WHERE indicator IN ('m1', 'm2') GROUP BY period)""", "macro"))
def money_gap(spark, sf_dir):
    return _r(C.money_gap(_tables(spark, sf_dir)["macro"]), "m1_yoy_pct", "m2_yoy_pct")


@query("macro_snapshot", sql("""SELECT indicator, max(period) AS period, round(arg_max(value, period), 6) AS value, count(*) AS points
 FROM macro GROUP BY indicator""", "macro"))
def macro_snapshot(spark, sf_dir):
    df = C.macro_snapshot(_tables(spark, sf_dir)["macro"])
    return df.select("indicator", "latest.period", F.round("latest.value", 6).alias("value"), "points")


# --- quality -----------------------------------------------------------------------

_ROUNDED = """SELECT ts_code, y, round(total_revenue / 1e8, 2) AS rev, round(n_income_attr_p / 1e8, 2) AS np,
 round(non_oper_income / nullif(operate_profit, 0) * 100, 2) AS nr FROM annual"""


def _again(col: str, suffix: str) -> str:
    """Growth recomputed from rounded values against the declared rate."""
    declared = f"round(max(r.{'revenue' if col == 'rev' else 'profit'}_cagr_{suffix}_pct), 2)"
    if suffix == "full":
        expected = f"""CASE WHEN count(*) FILTER (a.{col} > 0) >= 2 THEN round((pow(arg_max(a.{col}, a.y) FILTER (a.{col} > 0) /
          arg_min(a.{col}, a.y) FILTER (a.{col} > 0), 1.0::DOUBLE / (max(a.y) FILTER (a.{col} > 0) - min(a.y) FILTER (a.{col} > 0))) - 1) * 100, 2) END"""
    else:
        expected = f"""round((pow(arg_max(a.{col}, a.y) FILTER (a.{col} > 0) /
          max(CASE WHEN a.y = a.last_{col} - 5 AND a.{col} > 0 THEN a.{col} END), 1.0::DOUBLE / 5) - 1) * 100, 2)"""
    return f"""SELECT a.ts_code, {expected} AS e, {declared} AS d, count(*) AS n
 FROM (SELECT *, max(y) FILTER (rev > 0) OVER (PARTITION BY ts_code) AS last_rev, max(y) FILTER (np > 0) OVER (PARTITION BY ts_code) AS last_np
       FROM rounded) a JOIN rates r ON r.ts_code = a.ts_code GROUP BY a.ts_code"""


_DQ = {
    "dq_growth": " UNION ALL ".join(
        f"SELECT ts_code, 'DQ15' AS rule_id, 'E' AS severity, 'annual.{name}_cagr_{suffix}_pct' AS detail FROM ({_again(col, suffix)}) "
        "WHERE n >= 2 AND NOT ((e IS NULL AND d IS NULL) OR coalesce(abs(e - d) <= 0.15, false))"
        for name, col in (("revenue", "rev"), ("profit", "np")) for suffix in ("full", "5y")),
}


def _rule(rule: str, severity: str, detail: str, broken: str, source: str = "w") -> str:
    return f"SELECT ts_code, '{rule}', '{severity}', '{detail}' FROM {source} WHERE {broken}"


_W = f"""SELECT s.ts_code, m.trade_date, m.close, round(m.total_mv / 1e4, 2) AS mv, round(m.total_share / 1e4, 2) AS sh,
 a.n AS an, a.last_y, a.rev, a.np, a.nr_missing, coalesce(t.period_count, 0) AS pc, t.has_inferred, t.contiguous,
 q.*  EXCLUDE (ts_code), b.end_date AS b_end, b.total_assets, b.equity, b.money_cap, b.goodwill, b.debt,
 i.end_date AS i_end, i.roe, i.gross, i.net, i.debt AS i_debt, d.end_date AS d_end, p.metrics, p.least
 FROM stocks s LEFT JOIN mkt m USING (ts_code)
 LEFT JOIN (SELECT ts_code, count(*) AS n, max(y) AS last_y, arg_max(rev, y) AS rev, arg_max(np, y) AS np, bool_or(nr IS NULL) AS nr_missing FROM rounded GROUP BY 1) a USING (ts_code)
 LEFT JOIN ttm t USING (ts_code)
 LEFT JOIN (SELECT ts_code, max(end_date) AS q_end, bool_or(income_kind = 'inferred_ytd' OR cashflow_kind = 'inferred_ytd') AS inferred,
   count(revenue) FILTER (pos <= 4) AS n_rev, count(net_profit) FILTER (pos <= 4) AS n_np, count(ocf) FILTER (pos <= 4) AS n_ocf,
   count(capex) FILTER (pos <= 4) AS n_capex, sum(round(ocf / 1e8, 2)) FILTER (pos <= 4) AS s_ocf,
   sum(round(capex / 1e8, 2)) FILTER (pos <= 4) AS s_capex,
   CASE WHEN count(fcf) FILTER (pos <= 4) = 4 THEN sum(round(fcf / 1e8, 2)) FILTER (pos <= 4) END AS s_fcf FROM shown GROUP BY 1) q USING (ts_code)
 LEFT JOIN (SELECT * FROM bal3 WHERE pos = 1) b USING (ts_code) LEFT JOIN (SELECT * FROM ind6 WHERE pos = 1) i USING (ts_code)
 LEFT JOIN (SELECT * FROM aud3 WHERE pos = 1) d USING (ts_code)
 LEFT JOIN (SELECT ts_code, count(*) AS metrics, min(n) AS least FROM cmp WHERE n > 0 GROUP BY 1) p USING (ts_code)"""

_FOUR = "pc >= 4 AND "
_OK = "(contiguous AND n_ocf = 4)"
_USABLE = "(contiguous AND NOT has_inferred"
_RULES = [
    _rule("DQ3", "E", "market.ts_code", "trade_date IS NULL"), _rule("DQ4", "E", "market.trade_date", "trade_date IS NULL"),
    _rule("DQ5", "E", "market.close", "close IS NULL"), _rule("DQ6", "E", "market.total_mv_yi", "mv IS NULL"),
    _rule("DQ7", "E", "market.trade_date age", f"date_diff('day', trade_date, {AS_OF}) NOT BETWEEN 0 AND 7"),
    _rule("DQ8", "E", "annual.count", "an IS NULL"), _rule("DQ13", "E", "annual newest year", f"last_y <> {FY}"),
    _rule("DQ14", "E", "annual newest revenue_yi", "an >= 1 AND rev IS NULL"),
    _rule("DQ14", "E", "annual newest net_profit_yi", "an >= 1 AND np IS NULL"),
    _rule("DQ16", "W", "annual fewer than 3 years", "an < 3"), _rule("DQ17", "E", "quarterly fewer than 4 quarters", "pc < 4"),
    _rule("DQ19", "E", "quarterly contiguous", _FOUR + "NOT contiguous"),
    _rule("DQ20", "E", "quarterly newest age", _FOUR + f"date_diff('day', q_end, {AS_OF}) NOT BETWEEN 0 AND 200"),
    _rule("DQ21", "E", "quarterly revenue_yi", _FOUR + "n_rev < 4"),
    _rule("DQ21", "E", "quarterly net_profit_yi", _FOUR + "n_np < 4"), _rule("DQ21", "E", "quarterly ocf_yi", _FOUR + "n_ocf < 4"),
    _rule("DQ22", "E", "quarterly.ocf_ttm_complete agrees", _FOUR + f"{_USABLE} AND n_ocf = 4) <> {_OK}"),
    _rule("DQ22", "E", "quarterly ocf complete", _FOUR + f"NOT {_OK}"),
    _rule("DQ23", "E", "quarterly.ocf_ttm_yi", _FOUR + _OK + " AND (has_inferred OR abs(round((SELECT ocf4 FROM ttm WHERE ttm.ts_code = w.ts_code) / 1e8, 2) - s_ocf) > 0.0500001)"),
    _rule("DQ25", "E", "quarterly.cap_ex_ttm_yi", _FOUR + "n_capex = 4 AND (has_inferred OR NOT contiguous OR abs(round((SELECT capex4 FROM ttm WHERE ttm.ts_code = w.ts_code) / 1e8, 2) - s_capex) > 0.0500001)"),
    _rule("DQ25", "E", "quarterly.fcf_ttm_yi", _FOUR + "n_capex = 4 AND (has_inferred OR NOT contiguous OR s_fcf IS NULL OR abs(round((SELECT fcf4 FROM ttm WHERE ttm.ts_code = w.ts_code) / 1e8, 2) - s_fcf) > 0.0500001)"),
    _rule("DQ26", "W", "quarterly capex missing", _FOUR + "n_capex < 4"),
    _rule("DQ26", "W", "quarterly fcf ttm incomplete", _FOUR + f"n_capex = 4 AND NOT {_USABLE} AND n_ocf = 4)"),
    _rule("DQ27", "W", "quarterly inferred basis", "inferred"),
    _rule("DQ3", "E", "balance.ts_code", "b_end IS NULL"), _rule("DQ28", "E", "balance.end_date", "b_end IS NULL"),
    _rule("DQ29", "E", "balance year", f"year(b_end) <> {FY}"), _rule("DQ30", "E", "balance.total_assets_yi", "total_assets IS NULL"),
    _rule("DQ30", "E", "balance.equity_yi", "equity IS NULL"), _rule("DQ31", "W", "balance.cash_yi", "money_cap IS NULL"),
    _rule("DQ32", "W", "balance.goodwill_yi", "goodwill IS NULL"), _rule("DQ33", "W", "balance.interest_debt_yi", "debt IS NULL"),
    _rule("DQ34", "E", "indicators.count", "i_end IS NULL"), _rule("DQ34", "E", "indicators newest year", f"year(i_end) <> {FY}"),
    *[_rule("DQ34", "E", f"indicators newest {n}", f"i_end IS NOT NULL AND {c} IS NULL")
      for n, c in (("roe_pct", "roe"), ("gross_margin_pct", "gross"), ("net_margin_pct", "net"), ("debt_ratio_pct", "i_debt"))],
    _rule("DQ35", "E", "audit.latest", "d_end IS NULL"), _rule("DQ36", "E", "audit year", f"coalesce(year(d_end), 0) <> {FY}"),
    _rule("DQ37", "E", "market.total_mv_yi vs price x shares", "abs(mv - close * sh) / (close * sh) > 0.05"),
    _rule("DQ38", "W", "industry without peers", "metrics IS NULL"), _rule("DQ39", "W", "industry fewer than 5 peers", "least < 5"),
    _rule("DQ41", "W", "macro", "true"), _rule("DQ42", "W", "annual non_recurring_pct", "nr_missing"),
]
from ledgerlens.bindings import sqltables as _st  # noqa: E402

_st.block("rounded", _ROUNDED, "annual")
_st.block("w", _W, "stocks", "mkt", "rounded", "ttm", "shown", "bal3", "ind6", "aud3", "cmp")
_st.block("dqs", "SELECT ts_code, count(*) FILTER (severity = 'E') AS errors FROM dq GROUP BY 1", "dq")
_st.block("dq", _DQ["dq_growth"] + " UNION ALL " + " UNION ALL ".join(_RULES), "rounded", "rates", "w", "ttm")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The company documents as a stored table, which is what the rules and the facts read."""
    make = {"sections": lambda: snapshot.company_sections(_tables(spark, sf_dir), DAY)}
    return StagedTables(spark, sf_dir, make)["sections"]


@query("dq_violations", sql("SELECT * FROM dq", "dq"))
def dq_violations(spark, sf_dir):
    return quality.violations(sections(spark, sf_dir), _on())


@query("dq_status", sql("""SELECT s.ts_code, CASE WHEN count(d.rule_id) FILTER (severity = 'E') > 0 THEN 'FAIL'
 WHEN count(d.rule_id) > 0 THEN 'WARN' ELSE 'PASS' END AS status, count(d.rule_id) FILTER (severity = 'E') AS errors,
 count(d.rule_id) FILTER (severity = 'W') AS warnings FROM stocks s LEFT JOIN dq d ON d.ts_code = s.ts_code GROUP BY s.ts_code""", "stocks", "dq"))
def dq_status(spark, sf_dir):
    return quality.verdicts(sections(spark, sf_dir), _on())


@query("declared_quality", sql("SELECT ts_code, 'PASS' AS declared, status AS recomputed FROM (SELECT s.ts_code, s.industry, CASE WHEN count(d.rule_id) FILTER (severity = 'E') > 0 THEN 'FAIL' "
 "WHEN count(d.rule_id) > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM stocks s LEFT JOIN dq d ON d.ts_code = s.ts_code GROUP BY ALL) WHERE industry = 'ASIA' AND status <> 'PASS'", "stocks", "dq"))
def declared_quality(spark, sf_dir):
    """Stored verdicts against the rules; those of one industry were changed to a clean pass."""
    stored = quality.with_verdict(sections(spark, sf_dir), _on())
    none = F.array().cast("array<string>")
    clean = F.struct(F.lit("PASS").alias("status"), none.alias("errors"), none.alias("warnings"))
    forged = stored.withColumn("data_quality", F.when(F.col("stock_info.industry") == "ASIA", clean).otherwise(F.col("data_quality")))
    return quality.declared_differs(forged, _on()).select("ts_code", "declared.status", "recomputed.status").toDF("ts_code", "declared", "recomputed")


@query("verdict_envelopes", sql("""SELECT ts_code, 'status' AS problem FROM dqs WHERE errors > 0 UNION ALL SELECT ts_code, 'errors_not_empty' FROM dqs WHERE errors > 0""", "dqs"))
def verdict_envelopes(spark, sf_dir):
    stored = quality.with_verdict(sections(spark, sf_dir), _on())
    return stored.select("ts_code", F.explode(quality.envelope_problems(F.col("data_quality"))).alias("problem"))


@query("company_facts")
def company_facts(spark, sf_dir):
    docs = sections(spark, sf_dir)
    return snapshot.facts(docs, sections=list(snapshot.SECTIONS))


@query("market_facts", sql("""SELECT ts_code, ord, path, round(value, 6) AS value, unit FROM (
 SELECT ts_code, 0 AS ord, 'market.close' AS path, close AS value, '' AS unit FROM mkt
 UNION ALL SELECT ts_code, 1, 'market.total_mv_yi', round(total_mv / 1e4, 2), '亿' FROM mkt
 UNION ALL SELECT ts_code, 2, 'market.total_shares_wan', total_share, '万' FROM mkt)""", "mkt"))
def market_facts(spark, sf_dir):
    docs = C.market(_tables(spark, sf_dir), DAY).select(
        "ts_code", F.struct("close", "total_mv_yi", "total_shares_wan").alias("market"))
    return _r(snapshot.facts(docs), "value")


def _trees(spark, sf_dir) -> DataFrame:
    """Every document as a JSON text: its lines one by one, and a number below up to 400 levels of objects and arrays."""
    d = proxy.raw(spark, sf_dir, "documents")
    levels = (F.col("doc_id") % 201).cast("int")
    deep = F.concat(F.repeat(F.lit('{"in":['), levels), F.col("n_chars").cast("string"), F.repeat(F.lit("]}"), levels))
    line = F.transform(F.split("text", "\n"), lambda x: F.struct(F.char_length(x).alias("size_wan"), x.alias("text")))
    flat = F.to_json(F.struct("doc_id", F.struct("lang", "source", F.lit(2.5).alias("rate")).alias("meta"), line.alias("lines")))
    return d.select("doc_id", F.concat(F.regexp_replace(flat, r"\}$", ""), F.lit(',"deep":'), deep, F.lit("}")).alias("json"))


@query("json_document_facts", """WITH line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
 SELECT doc_id, 'doc_id' AS path, doc_id::DOUBLE AS value, '' AS unit FROM documents UNION ALL SELECT doc_id, 'meta.rate', 2.5, '%' FROM documents
 UNION ALL SELECT doc_id, 'lines[' || i || '].size_wan', length(x)::DOUBLE, '万' FROM line
 UNION ALL SELECT doc_id, 'deep' || repeat('.in[0]', (doc_id % 201)::INTEGER), n_chars::DOUBLE, '' FROM documents WHERE n_chars IS NOT NULL""")
def json_document_facts(spark, sf_dir):
    return snapshot.json_facts(_trees(spark, sf_dir), ("doc_id",)).drop("ord")


@query("json_document_paths", """WITH line AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
 level AS (SELECT doc_id, unnest(range((doc_id % 201)::BIGINT)) AS k FROM documents WHERE n_chars IS NOT NULL)
 SELECT doc_id, unnest(['doc_id', 'meta', 'meta.rate', 'lines', 'deep']) AS path FROM documents
 UNION ALL SELECT doc_id, 'meta.lang' FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, 'meta.source' FROM documents WHERE source IS NOT NULL
 UNION ALL SELECT doc_id, unnest(['lines[' || i || ']', 'lines[' || i || '].size_wan', 'lines[' || i || '].text']) FROM line
 UNION ALL SELECT doc_id, unnest(['deep' || repeat('.in[0]', k::INTEGER) || '.in', 'deep' || repeat('.in[0]', k::INTEGER + 1)]) FROM level""")
def json_document_paths(spark, sf_dir):
    return snapshot.json_paths(_trees(spark, sf_dir), ("doc_id",))


@query("company_documents", sql("""SELECT s.ts_code, s.name, s.industry, strftime(k.trade_date, '%Y%m%d') AS trade_date, round(k.close, 6) AS close,
 m.period AS m1_period, m.value AS m1_value, true AS strict,
 (SELECT count(*) FROM dq WHERE dq.ts_code = s.ts_code AND severity = 'W' AND rule_id <> 'DQ41') AS warnings
 FROM stocks s LEFT JOIN mkt k ON k.ts_code = s.ts_code
 LEFT JOIN (SELECT max(period) AS period, round(arg_max(value, period), 6) AS value FROM macro WHERE indicator = 'm1') m ON true""",
 "stocks", "mkt", "dq", "macro"))
def company_documents(spark, sf_dir):
    """The JSON documents with current macro readings, their fields read back from the text."""
    t = _tables(spark, sf_dir)
    docs = src.finite_columns(snapshot.company_document(t, DAY, t["macro"]))
    text = docs.select("ts_code", F.to_json(F.struct(*docs.columns)).alias("document"))
    at = lambda path: F.get_json_object("document", path)
    return text.select(
        "ts_code", at("$.stock_info.name").alias("name"), at("$.stock_info.industry").alias("industry"), at("$.market.trade_date").alias("trade_date"),
        F.round(at("$.market.close").cast("double"), 6).alias("close"), at("$.macro.series.m1.period").alias("m1_period"),
        F.round(at("$.macro.series.m1.value").cast("double"), 6).alias("m1_value"), (~F.col("document").rlike(r"NaN|Infinity")).alias("strict"),
        F.json_array_length(at("$.data_quality.warnings")).cast("long").alias("warnings"))
