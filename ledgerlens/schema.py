"""Column layout of the canonical tables.

Dates are real dates, money is double (yuan unless noted), NULL is unknown.
"""

from __future__ import annotations

_STATEMENT_KEY = dict(
    ts_code="string", ann_date="date", f_ann_date="date", end_date="date", report_type="string"
)


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in columns.items())


def _doubles(*names: str) -> dict[str, str]:
    return {n: "double" for n in names}


TABLES: dict[str, str] = {
    "stocks": _ddl(
        dict(
            ts_code="string", symbol="string", name="string", fullname="string",
            exchange="string", list_date="date", delist_date="date",
            industry_sw="string", area="string", updated_at="date",
        )
    ),
    "sectors": _ddl(
        dict(sector_code="string", name="string", category="string", sub_category="string",
             source="string", description="string", policy_ref="string")
    ),
    "stock_sectors": _ddl(
        dict(ts_code="string", sector_code="string", weight="double", source="string")
    ),
    "daily_quotes": _ddl(
        dict(ts_code="string", trade_date="date")
        | _doubles("open", "high", "low", "close", "pre_close", "change", "pct_chg", "vol",
                   "amount", "adj_factor")
    ),
    # total_mv, circ_mv and the share counts are in units of 10 thousand
    "daily_basic": _ddl(
        dict(ts_code="string", trade_date="date")
        | _doubles("close", "turnover_rate", "turnover_rate_f", "volume_ratio", "pe", "pe_ttm",
                   "pb", "ps", "ps_ttm", "dv_ratio", "total_mv", "circ_mv", "total_share",
                   "float_share", "free_share")
    ),
    "income": _ddl(
        _STATEMENT_KEY
        | _doubles("total_revenue", "revenue", "total_cogs", "sell_exp", "admin_exp", "fin_exp",
                   "rd_exp", "operate_profit", "total_profit", "n_income", "n_income_attr_p",
                   "non_oper_income")
    ),
    "balance": _ddl(
        _STATEMENT_KEY
        | _doubles("total_assets", "total_liab", "total_hldr_eqy_inc_min_int",
                   "total_hldr_eqy_exc_min_int", "money_cap", "trad_asset", "notes_receiv",
                   "accounts_receiv", "inventories", "goodwill", "intan_assets", "fix_assets",
                   "st_borr", "lt_borr", "bonds_payable", "total_nca", "total_cur_liab",
                   "total_noncur_liab", "total_share")
    ),
    "cashflow": _ddl(
        _STATEMENT_KEY
        | _doubles("n_cashflow_act", "n_cashflow_inv_act", "n_cash_flows_fnc_act",
                   "c_cash_equ_end_period", "c_pay_acq_const_fiolta", "free_cash_flow")
    ),
    "fina_indicators": _ddl(
        dict(ts_code="string", ann_date="date", end_date="date")
        | _doubles("roe", "roe_dt", "grossprofit_margin", "netprofit_margin", "debt_to_assets",
                   "current_ratio", "quick_ratio", "ocf_to_profit", "tr_yoy", "netprofit_yoy")
    ),
    "fina_audit": _ddl(
        dict(ts_code="string", ann_date="date", end_date="date", audit_result="string",
             audit_fees="double", audit_agency="string", audit_sign="string")
    ),
    # profits in 10 thousand yuan
    "forecast": _ddl(
        dict(ts_code="string", ann_date="date", end_date="date", type="string")
        | _doubles("p_change_min", "p_change_max", "net_profit_min", "net_profit_max",
                   "last_parent_net")
        | dict(summary="string")
    ),
    "annual_reports": _ddl(
        dict(ts_code="string", report_year="int", report_type="string", ann_date="date",
             title="string", section_name="string", section_text="string", source_url="string")
    ),
    # r1..r6: False = passed; the g, f, m and v columns hold the measured value
    "screen_results": _ddl(
        dict(ts_code="string", trade_date="date", sector_code="string", tier="string",
             score_total="double")
        | {f: "boolean" for f in ("r1_ocf_profit", "r2_ar_revenue", "r3_debt_cash", "r4_goodwill",
                                  "r5_audit", "r6_ocf_pos")}
        | _doubles("g1_graham", "g2_ey_spread")
        | dict(g3_profit_streak="int")
        | _doubles("f1_rev_cagr", "f2_profit_cagr", "m1_roe_avg", "m2_roic", "m3_gm", "v1_pe_ttm",
                   "v2_pb")
        | dict(result="string", reason="string")
    ),
    "analysis_queue": _ddl(
        dict(ts_code="string", sector_code="string", scheduled_date="date", analyzed_date="date",
             status="string", report_path="string", notes="string")
    ),
    "candidates": _ddl(
        dict(ts_code="string", first_screen_date="date", latest_screen_date="date",
             rating="string", moat_score="int", valuation_score="int", risk_score="int",
             report_path="string", notes="string")
    ),
    "macro_rates": _ddl(dict(date="date", rate_type="string", rate="double")),
    "macro": _ddl(dict(indicator="string", period="string", value="double", yoy_pct="double")),
    "trace_events": _ddl(
        dict(ts="string", code="string", name="string", phase="string", status="string",
             expert_id="string", duration_ms="double", exit_code="int", msg="string",
             score="int", verdict="string")
    ),
    "facts": _ddl(
        dict(ts_code="string", batch_id="string", ord="int", path="string", value="double",
             unit="string")
    ),
    "manifest": _ddl(
        dict(ts_code="string", run_id="string", name="string", sha256="string", bytes="bigint")
    ),
}

#: natural key of each stored table
KEYS: dict[str, tuple[str, ...]] = {
    "stocks": ("ts_code",),
    "daily_quotes": ("ts_code", "trade_date"),
    "daily_basic": ("ts_code", "trade_date"),
    "income": ("ts_code", "end_date", "report_type"),
    "balance": ("ts_code", "end_date", "report_type"),
    "cashflow": ("ts_code", "end_date", "report_type"),
    "fina_indicators": ("ts_code", "end_date"),
    "fina_audit": ("ts_code", "end_date"),
    "forecast": ("ts_code", "ann_date", "end_date"),
    "annual_reports": ("ts_code", "report_year", "report_type", "section_name"),
}

#: column to partition a table by on disk
PARTITION_BY: dict[str, str] = {
    "daily_quotes": "trade_month",
    "daily_basic": "trade_month",
    "income": "fiscal_year",
    "balance": "fiscal_year",
    "cashflow": "fiscal_year",
    "fina_indicators": "fiscal_year",
}

# The seven analyst roles.
EXPERTS = (
    "financial-auditor",
    "value-valuator",
    "growth-assessor",
    "moat-analyst",
    "cognitive-controller",
    "macro-cyclist",
    "management-auditor",
)


def column_names(table: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in TABLES[table].split(",")]
