"""The same derived tables and reads as DuckDB SQL, for checking the Spark queries.

``sql(query, *needs)`` puts the named building blocks in front of a query.
"""

from __future__ import annotations

AS_OF = "DATE '2001-06-15'"
FY = 2000  # fiscal year that must be public on that day

CODE = """(reverse(lpad({k}::VARCHAR, greatest(6, length({k}::VARCHAR))::INTEGER, '0')) || '.' ||
 CASE WHEN left(reverse(lpad({k}::VARCHAR, greatest(6, length({k}::VARCHAR))::INTEGER, '0')), 1) IN ('5','6','9') THEN 'SH'
      WHEN left(reverse(lpad({k}::VARCHAR, greatest(6, length({k}::VARCHAR))::INTEGER, '0')), 1) IN ('4','8') THEN 'BJ'
      ELSE 'SZ' END)"""


def code(k: str) -> str:
    return CODE.format(k=k)


BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, body: str, *needs: str) -> None:
    BLOCKS[name] = (needs, body)


def positive_zero(query: str) -> str:
    """Rounding may leave -0.0, which equals 0.0 but prints differently; adding zero removes the sign."""
    out, at = "", 0
    while (start := query.find("round(", at)) >= 0:
        depth, end = 0, start + 5
        while True:
            depth += {"(": 1, ")": -1}.get(query[end], 0)
            end += 1
            if depth == 0:
                break
        inner = positive_zero(query[start + 6 : end - 1])
        out += f"{query[at:start]}(round({inner}) + 0.0::DOUBLE)"
        at = end
    return out + query[at:]


def sql(query: str, *needs: str) -> str:
    return positive_zero(_with_blocks(query, *needs))


def _with_blocks(query: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for n in BLOCKS[name][0]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return query
    return "WITH " + ",\n".join(f"{n} AS ({BLOCKS[n][1]})" for n in order) + "\n" + query


block("li", """SELECT l_suppkey AS k, l_shipdate::DATE AS d, year(l_shipdate) AS y, quarter(l_shipdate) AS q,
 round(l_extendedprice * 100)::BIGINT AS cents, round(l_discount * 100)::BIGINT AS disc,
 round(l_tax * 100)::BIGINT AS tax, l_quantity::BIGINT AS qty, l_linenumber AS ln,
 l_returnflag AS flag, l_linestatus AS st FROM lineitem""")

PROF = "cents * (CASE flag WHEN 'N' THEN 10 WHEN 'A' THEN 8 ELSE -12 END)"

block("qsum", f"""SELECT k, y, q, sum(cents * (100 - disc))::BIGINT AS rev, sum(cents * 100)::BIGINT AS gross,
 sum({PROF})::BIGINT AS prof, sum(cents * 80)::BIGINT AS cogs, sum(cents * disc)::BIGINT AS sell,
 sum(cents * tax) FILTER (ln = 7)::BIGINT AS rd, sum(cents * (10 - disc))::BIGINT AS oper,
 sum(cents) FILTER (qty >= 45)::BIGINT AS nonop,
 sum(CASE WHEN st = 'F' THEN cents * 9 ELSE cents * 3 END)::BIGINT AS ocf, sum(-cents * tax)::BIGINT AS inv,
 sum(cents * tax) FILTER (ln <= 3 AND tax >= 6)::BIGINT AS capex,
 min(cents) AS min_cents, max(cents) AS max_cents, max(disc) AS max_disc, max(tax) AS max_tax, count(*) AS n,
 bool_or(ln = 1) AS has1, bool_or(ln = 2) AS has2, bool_or(ln = 4) AS has4, bool_or(ln = 5) AS has5,
 bool_or(ln = 6) AS has6, bool_or(tax IN (0, 8)) AS typed_i, bool_or(disc IN (0, 5, 10)) AS typed_c,
 bool_or(qty = 50 AND flag = 'R') AS extra, bool_or(qty = 50) AS warned
 FROM li GROUP BY k, y, q""", "li")

_FLOWS = ("rev", "prof", "cogs", "sell", "rd", "oper", "nonop", "ocf", "inv", "capex")
block("qb", "SELECT *, " + ", ".join(
    f"CASE WHEN {f} IS NOT NULL THEN (sum({f}) OVER w)::BIGINT END AS {f}_y" for f in _FLOWS) + f""",
 {code('k')} AS ts_code, last_day(make_date(y, q * 3, 1)) AS end_date,
 CASE WHEN has5 THEN last_day(make_date(y, q * 3, 1)) + 30 END AS ann_date,
 CASE WHEN has6 THEN last_day(make_date(y, q * 3, 1)) + 45 END AS f_ann_date
 FROM qsum WINDOW w AS (PARTITION BY k, y ORDER BY q ROWS UNBOUNDED PRECEDING)""", "qsum")

_INC = dict(total_revenue="rev", n_income_attr_p="prof", total_cogs="cogs", sell_exp="sell", rd_exp="rd",
            operate_profit="oper", non_oper_income="nonop")
block("income", "SELECT ts_code, ann_date, f_ann_date, end_date, "
      "CASE WHEN NOT typed_i THEN NULL WHEN NOT has4 THEN '3' ELSE '1' END AS report_type, "
      + ", ".join(f"{v}_y::DOUBLE AS {n}" for n, v in _INC.items())
      + " FROM qb WHERE has1 UNION ALL SELECT ts_code, ann_date, f_ann_date, end_date, '2', "
      + ", ".join(("gross" if n == "total_revenue" else v) + f"::DOUBLE AS {n}" for n, v in _INC.items())
      + " FROM qb WHERE has1 AND extra", "qb")
block("cashflow", """SELECT ts_code, ann_date, f_ann_date, end_date, CASE WHEN typed_c THEN '1' END AS report_type,
 ocf_y::DOUBLE AS n_cashflow_act, inv_y::DOUBLE AS n_cashflow_inv_act, capex_y::DOUBLE AS c_pay_acq_const_fiolta
 FROM qb WHERE has2""", "qb")
block("forecast", """SELECT ts_code, end_date - 15 AS ann_date, end_date, CASE WHEN prof > 0 THEN 'up' ELSE 'down' END AS type,
 (-max_disc)::DOUBLE AS p_change_min, max_tax::DOUBLE AS p_change_max, min_cents::DOUBLE / 6.9997::DOUBLE AS net_profit_min,
 max_cents::DOUBLE / 6.9997::DOUBLE AS net_profit_max, prof::DOUBLE / 69997.0::DOUBLE AS last_parent_net, 'lines ' || n AS summary
 FROM qb WHERE warned""", "qb")

block("yb", f"""SELECT k, y, {code('k')} AS ts_code, make_date(y, 12, 31) AS end_date,
 sum(cents * 100)::BIGINT AS assets, sum(cents * (40 + disc))::BIGINT AS liab, sum(cents * (60 - disc))::BIGINT AS equity,
 sum(cents * 100) FILTER (flag = 'N' AND ln <= 3)::BIGINT AS cash, sum(cents * 50) FILTER (ln = 1)::BIGINT AS st,
 sum(cents * 50) FILTER (ln = 2)::BIGINT AS lt, sum(cents * 50) FILTER (ln = 3 AND qty >= 40)::BIGINT AS bonds,
 sum(cents * 100) FILTER (flag = 'R' AND qty <= 2)::BIGINT AS goodwill, sum(cents * 100) FILTER (flag = 'A')::BIGINT AS receiv,
 sum(cents * 100) FILTER (flag = 'N')::BIGINT AS stock, count(*) FILTER (qty = 1) AS ones,
 sum(cents * (100 - disc))::BIGINT AS rev, sum(cents * 80)::BIGINT AS cogs, sum({PROF})::BIGINT AS prof,
 bool_or(flag = 'A' AND tax = 8) AS ann, bool_or(flag = 'A' AND ln = 1) AS rated
 FROM li GROUP BY k, y""", "li")
block("balance", """SELECT ts_code, CASE WHEN ann THEN end_date + 60 END AS ann_date, end_date + 75 AS f_ann_date, end_date,
 '1' AS report_type, assets::DOUBLE AS total_assets, liab::DOUBLE AS total_liab, equity::DOUBLE AS equity,
 cash::DOUBLE AS money_cap, st::DOUBLE AS st_borr, lt::DOUBLE AS lt_borr, bonds::DOUBLE AS bonds_payable,
 goodwill::DOUBLE AS goodwill, receiv::DOUBLE AS accounts_receiv, stock::DOUBLE AS inventories FROM yb""", "yb")
block("ind", """SELECT ts_code, end_date + 60 AS ann_date, end_date, prof::DOUBLE / equity::DOUBLE * 100 AS roe,
 (rev - cogs)::DOUBLE / rev::DOUBLE * 100 AS gross, prof::DOUBLE / rev::DOUBLE * 100 AS net,
 CASE WHEN ones >= 1 THEN liab::DOUBLE / assets::DOUBLE * 100 END AS debt, stock::DOUBLE / st::DOUBLE AS cur
 FROM yb WHERE rated""", "yb")
block("audits", """SELECT ts_code, end_date + 60 AS ann_date, end_date,
 CASE WHEN prof < 0 THEN 'qualified' WHEN NOT ann THEN 'emphasis' ELSE 'standard' END AS audit_result,
 rev::DOUBLE / 1e2 AS audit_fees, CASE WHEN ones > 0 THEN 'agency ' || ones END AS audit_agency FROM yb""", "yb")

block("stocks", f"""SELECT {code('s_suppkey')} AS ts_code,
 CASE WHEN s_acctbal < -400 THEN '*ST ' || s_name WHEN s_acctbal < 0 THEN '*st ' || s_name
      WHEN s_acctbal > 9700 THEN s_name || '退' ELSE s_name END AS name,
 CASE WHEN s_acctbal BETWEEN 9000 AND 9200 THEN DATE '1999-12-31' END AS delist_date, r_name AS industry, n_name AS area
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
block("firms", """SELECT *, (name NOT ILIKE '%ST%' AND name NOT LIKE '%退%' AND delist_date IS NULL) AS in_pool
 FROM stocks""", "stocks")

block("day", """SELECT k, d, sum(cents)::BIGINT AS c, sum(qty)::BIGINT AS q, sum(cents * (2 * tax - disc))::BIGINT AS earn,
 sum(cents * tax)::BIGINT AS ct, sum(cents * (100 + tax))::BIGINT AS mv, sum(cents * (tax - disc))::BIGINT AS chg
 FROM li GROUP BY k, d""", "li")
block("db", f"""SELECT {code('k')} AS ts_code, d AS trade_date, c::DOUBLE / q::DOUBLE / 99.97::DOUBLE AS close,
 c::DOUBLE * 100 / nullif(earn, 0)::DOUBLE AS pe_ttm, c::DOUBLE / q::DOUBLE / 99.97::DOUBLE / 700 AS pb,
 c::DOUBLE * 100 / nullif(ct, 0)::DOUBLE AS ps_ttm, mv::DOUBLE * 10 / 0.9997::DOUBLE AS total_mv, q::DOUBLE * 1e5 AS total_share FROM day""", "day")
block("quotes", f"""SELECT {code('k')} AS ts_code, d AS trade_date, c::DOUBLE / q::DOUBLE / 99.97::DOUBLE AS close,
 chg::DOUBLE / q::DOUBLE / 9997.0::DOUBLE AS change, q::DOUBLE AS vol FROM day""", "day")
block("macro", """SELECT CASE o_orderstatus WHEN 'F' THEN 'm1' WHEN 'O' THEN 'm2' ELSE 'pmi_' || left(o_orderpriority, 1) END AS indicator,
 strftime(o_orderdate, '%Y%m') AS period,
 sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / count(*)::DOUBLE / 5e5 AS value FROM orders GROUP BY 1, 2""")

# --- as-of reads -------------------------------------------------------------------

block("vis_income", f"SELECT *, year(end_date) AS y, quarter(end_date) AS q FROM income WHERE coalesce(ann_date, f_ann_date) <= {AS_OF}", "income")
block("vis_cash", f"SELECT *, year(end_date) AS y, quarter(end_date) AS q FROM cashflow WHERE coalesce(ann_date, f_ann_date) <= {AS_OF}", "cashflow")
block("vis_balance", f"SELECT * FROM balance WHERE coalesce(ann_date, f_ann_date) <= {AS_OF}", "balance")
block("vis_ind", f"SELECT * FROM ind WHERE ann_date <= {AS_OF}", "ind")
block("annual", "SELECT * FROM vis_income WHERE month(end_date) = 12 AND (report_type = '1' OR report_type IS NULL)", "vis_income")

block("mkt", f"""SELECT * FROM db WHERE trade_date <= {AS_OF}
 QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) = 1""", "db")


def _basis(src: str, flows: tuple[str, ...]) -> str:
    """Per period: own single-quarter row, cumulative row, where it came from."""
    direct = ", ".join(f"max({f}) FILTER (report_type = '2') AS d_{f}" for f in flows)
    ytd = ", ".join(
        f"CASE WHEN bool_or(coalesce(report_type, '') = '1') THEN max({f}) FILTER (report_type = '1') "
        f"WHEN bool_and(report_type IS NULL) THEN max({f}) END AS t_{f}" for f in flows)
    return f"""SELECT ts_code, end_date, y, q, {direct}, {ytd},
 bool_or(coalesce(report_type, '') = '1') OR bool_and(report_type IS NULL) AS has_ytd,
 CASE WHEN bool_or(coalesce(report_type, '') = '2') THEN 'single_quarter'
      WHEN bool_or(coalesce(report_type, '') = '1') THEN 'ytd'
      WHEN bool_and(report_type IS NULL) THEN 'inferred_ytd' ELSE 'unknown' END AS kind
 FROM {src} GROUP BY ts_code, end_date, y, q"""


def _single(src: str, flows: tuple[str, ...]) -> str:
    cols = ", ".join(
        f"coalesce(a.d_{f}, CASE WHEN a.q = 1 THEN a.t_{f} ELSE a.t_{f} - b.t_{f} END) AS {f}, a.t_{f}" for f in flows)
    return f"""SELECT a.ts_code, a.end_date, a.y, a.q, a.kind, {cols}
 FROM {src} a LEFT JOIN {src} b ON a.ts_code = b.ts_code AND a.y = b.y AND b.q = a.q - 1 AND b.has_ytd"""


_IF = ("total_revenue", "n_income_attr_p")
_CF = ("n_cashflow_act", "n_cashflow_inv_act", "c_pay_acq_const_fiolta")
block("ibasis", _basis("vis_income", _IF), "vis_income")
block("cbasis", _basis("vis_cash", _CF), "vis_cash")
block("isingle", _single("ibasis", _IF), "ibasis")
block("csingle", _single("cbasis", _CF), "cbasis")
block("sq", """SELECT coalesce(i.ts_code, c.ts_code) AS ts_code, coalesce(i.end_date, c.end_date) AS end_date,
 coalesce(i.y, c.y) AS y, coalesce(i.q, c.q) AS quarter, i.kind AS income_kind, c.kind AS cashflow_kind,
 i.total_revenue AS revenue, i.n_income_attr_p AS net_profit, c.n_cashflow_act AS ocf,
 c.n_cashflow_inv_act AS investing_cashflow, c.c_pay_acq_const_fiolta AS capex,
 i.t_total_revenue AS revenue_ytd, i.t_n_income_attr_p AS net_profit_ytd, c.t_n_cashflow_act AS ocf_ytd,
 c.t_c_pay_acq_const_fiolta AS capex_ytd, c.n_cashflow_act - c.c_pay_acq_const_fiolta AS fcf,
 c.t_n_cashflow_act - c.t_c_pay_acq_const_fiolta AS fcf_ytd
 FROM isingle i FULL JOIN csingle c ON i.ts_code = c.ts_code AND i.end_date = c.end_date""", "isingle", "csingle")
block("shown", "SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY end_date DESC) AS pos FROM sq QUALIFY pos <= 8", "sq")


def _four(f: str) -> str:
    return f"CASE WHEN count({f}) FILTER (pos <= 4) = 4 THEN sum({f}) FILTER (pos <= 4) END"


block("ttm", f"""SELECT ts_code, count(*) AS period_count,
 bool_or(coalesce(income_kind, '') = 'inferred_ytd' OR coalesce(cashflow_kind, '') = 'inferred_ytd') AS has_inferred,
 coalesce(max(y * 4 + quarter) FILTER (pos = 1) - max(y * 4 + quarter) FILTER (pos = 4) = 3, false) AS contiguous,
 {_four('ocf')} AS ocf4, {_four('capex')} AS capex4, {_four('fcf')} AS fcf4 FROM shown GROUP BY ts_code""", "shown")

block("bal3", """SELECT *, st_borr + lt_borr + bonds_payable AS debt, row_number() OVER (PARTITION BY ts_code ORDER BY end_date DESC) AS pos
 FROM vis_balance QUALIFY pos <= 3""", "vis_balance")
block("ind6", """SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY end_date DESC) AS pos FROM vis_ind QUALIFY pos <= 6""", "vis_ind")
block("aud3", f"""SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY end_date DESC) AS pos FROM audits
 WHERE ann_date <= {AS_OF} QUALIFY pos <= 3""", "audits")
block("fc3", f"""SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY ann_date DESC, end_date DESC) AS pos FROM forecast
 WHERE ann_date <= {AS_OF} QUALIFY pos <= 3""", "forecast")

block("growth", """SELECT ts_code, count(*) AS annual_count, min(y) AS first_year, max(y) AS last_year,
 min(y) FILTER (total_revenue > 0) AS ry0, max(y) FILTER (total_revenue > 0) AS ry1,
 arg_min(total_revenue, y) FILTER (total_revenue > 0) AS rv0, arg_max(total_revenue, y) FILTER (total_revenue > 0) AS rv1,
 min(y) FILTER (n_income_attr_p > 0) AS py0, max(y) FILTER (n_income_attr_p > 0) AS py1,
 arg_min(n_income_attr_p, y) FILTER (n_income_attr_p > 0) AS pv0, arg_max(n_income_attr_p, y) FILTER (n_income_attr_p > 0) AS pv1
 FROM annual GROUP BY ts_code""", "annual")
block("rates", """SELECT g.ts_code, annual_count, first_year, last_year,
 CASE WHEN ry1 > ry0 THEN (pow(rv1 / rv0, 1.0::DOUBLE / (ry1 - ry0)) - 1) * 100 END AS revenue_cagr_full_pct,
 CASE WHEN r5.total_revenue > 0 THEN (pow(rv1 / r5.total_revenue, 1.0::DOUBLE / 5) - 1) * 100 END AS revenue_cagr_5y_pct,
 CASE WHEN py1 > py0 THEN (pow(pv1 / pv0, 1.0::DOUBLE / (py1 - py0)) - 1) * 100 END AS profit_cagr_full_pct,
 CASE WHEN p5.n_income_attr_p > 0 THEN (pow(pv1 / p5.n_income_attr_p, 1.0::DOUBLE / 5) - 1) * 100 END AS profit_cagr_5y_pct
 FROM growth g LEFT JOIN annual r5 ON r5.ts_code = g.ts_code AND r5.y = g.ry1 - 5
 LEFT JOIN annual p5 ON p5.ts_code = g.ts_code AND p5.y = g.py1 - 5""", "growth", "annual")

# --- peers -------------------------------------------------------------------------

block("fin", f"""SELECT f.ts_code, f.industry, f.in_pool, m.* EXCLUDE (ts_code) FROM firms f JOIN (
 SELECT coalesce(a.ts_code, b.ts_code) AS ts_code, a.roe AS roe_pct, a.gross AS gross_margin_pct, a.net AS net_margin_pct,
  a.debt AS debt_ratio_pct, round(b.sell_exp / nullif(b.total_revenue, 0) * 100, 2) AS sell_expense_rate_pct,
  round(b.rd_exp / nullif(b.total_revenue, 0) * 100, 2) AS rd_expense_rate_pct
 FROM (SELECT * FROM vis_ind WHERE end_date = DATE '{FY}-12-31') a
 FULL JOIN (SELECT * FROM annual WHERE end_date = DATE '{FY}-12-31') b ON a.ts_code = b.ts_code) m ON m.ts_code = f.ts_code""",
      "firms", "vis_ind", "annual")
block("own_date", "SELECT f.ts_code, f.industry, f.in_pool, m.trade_date FROM firms f JOIN mkt m ON m.ts_code = f.ts_code", "firms", "mkt")
block("val", """SELECT f.ts_code, f.industry, f.in_pool, d.trade_date, d.pe_ttm, d.pb FROM db d JOIN firms f ON f.ts_code = d.ts_code
 WHERE (f.industry, d.trade_date) IN (SELECT industry, trade_date FROM own_date)""", "db", "firms", "own_date")
block("long", f"""SELECT ts_code, industry, in_pool, DATE '{FY}-12-31' AS period, metric, x,
 (x > 0 AND x < 500) AS ok, false AS valuation FROM fin UNPIVOT (x FOR metric IN
 (roe_pct, gross_margin_pct, net_margin_pct, debt_ratio_pct, sell_expense_rate_pct, rd_expense_rate_pct))
 UNION ALL SELECT ts_code, industry, in_pool, trade_date, metric, x, (x > 0 AND x < 500), true
 FROM val UNPIVOT (x FOR metric IN (pe_ttm, pb))""", "fin", "val")
block("pool", "SELECT *, (NOT valuation OR ok) AS in_stats, (metric <> 'pe_ttm' OR ok) AS in_rank FROM long WHERE in_pool", "long")
block("target", f"""SELECT f.ts_code, f.industry, DATE '{FY}-12-31' AS period, m.metric, l.x FROM firms f
 CROSS JOIN (VALUES ('roe_pct'), ('gross_margin_pct'), ('net_margin_pct'), ('debt_ratio_pct'), ('sell_expense_rate_pct'), ('rd_expense_rate_pct')) m(metric)
 LEFT JOIN long l ON l.ts_code = f.ts_code AND l.metric = m.metric AND NOT l.valuation
 UNION ALL SELECT o.ts_code, o.industry, o.trade_date, m.metric, l.x FROM own_date o CROSS JOIN (VALUES ('pe_ttm'), ('pb')) m(metric)
 LEFT JOIN long l ON l.ts_code = o.ts_code AND l.metric = m.metric AND l.valuation AND l.period = o.trade_date""", "firms", "long", "own_date")
block("cmp", """SELECT t.ts_code, t.industry, t.period, t.metric, t.x AS value, count(p.x) FILTER (p.in_stats) AS n,
 avg(p.x) FILTER (p.in_stats) AS mean, quantile_cont(p.x, 0.25) FILTER (p.in_stats) AS p25,
 quantile_cont(p.x, 0.5) FILTER (p.in_stats) AS median, quantile_cont(p.x, 0.75) FILTER (p.in_stats) AS p75,
 CASE WHEN t.x IS NOT NULL AND count(p.x) FILTER (p.in_stats) > 0
  THEN 100.0::DOUBLE * count(p.x) FILTER (p.in_rank AND p.x <= t.x) / nullif(count(p.x) FILTER (p.in_rank), 0) END AS rank_pct
 FROM target t LEFT JOIN pool p ON p.industry = t.industry AND p.period = t.period AND p.metric = t.metric AND p.ts_code <> t.ts_code
 GROUP BY t.ts_code, t.industry, t.period, t.metric, t.x HAVING t.x IS NOT NULL OR count(p.x) FILTER (p.in_stats) > 0""", "target", "pool")
