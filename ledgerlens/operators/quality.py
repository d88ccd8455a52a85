"""Data-quality rules on the company document.

The rules are SQL conditions over one company row, so all rules of all companies
are one projection without a shuffle.  Values that several rules need are named
once in ``_named`` below.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import values as V

PROBLEM = "array<struct<rule_id:string,severity:string,detail:string>>"
SECTIONS_WITH_CODE = ("market", "annual", "quarterly", "balance", "indicators", "audit", "industry", "forecast")
# Sections that answer without data as well; the others have no code when they are empty.
ALWAYS_CODED = ("annual", "quarterly", "indicators", "audit", "industry", "forecast")
FIRST_FOUR = (1, 2, 3, 4)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str  # E or W
    detail: str
    broken: str


def _known4(field: str) -> str:
    """All four newest quarters carry the field."""
    return "(" + " and ".join(f"abs(q{i}.{field}) < double('infinity')" for i in FIRST_FOUR) + ")"


def _sum4(field: str) -> str:
    return "round(" + " + ".join(f"q{i}.{field}" for i in FIRST_FOUR) + ", 2)"


def _growth_again(field: str, horizon: int | None) -> str:
    """Growth recomputed from the shown (rounded) annual values."""
    points = f"{field}_points"
    last = f"element_at({points}, -1)"
    if horizon is None:
        first = f"element_at({points}, 1)"
    else:
        first = f"try_element_at(filter({points}, r -> r.year = {last}.year - {horizon}), 1)"
    years = f"({last}.year - {first}.year)"
    rate = f"(pow({last}.{field} / {first}.{field}, 1D / {years}) - 1) * 100"
    return f"(case when size({points}) >= 2 and {years} > 0 then round({rate}, 2) end)"


def _named(documents: DataFrame, as_of: Column) -> DataFrame:
    """The document with the values the rules share."""
    q = "try_element_at(quarterly.periods, {i})"
    first = documents.withColumns(
        {
            "code": V.normalize_code("ts_code"),
            "today": as_of,
            "fy": V.fiscal_year_available(as_of),
            "traded": V.as_date("market.trade_date"),
            "rows": F.expr("coalesce(annual.annual_data, array())"),
            "years": F.expr("coalesce(transform(annual.annual_data, r -> r.year), array())"),
            "revenue_yi_points": F.expr("filter(annual.annual_data, r -> r.revenue_yi > 0)"),
            "net_profit_yi_points": F.expr("filter(annual.annual_data, r -> r.net_profit_yi > 0)"),
            "shown": F.expr("coalesce(size(quarterly.periods), 0)"),
            **{f"q{i}": F.expr(q.format(i=i)) for i in FIRST_FOUR},
            **{f"d{i}": V.as_date(F.expr(q.format(i=i) + ".period")) for i in FIRST_FOUR},
            "newest_ind": F.expr("try_element_at(indicators.indicators, 1)"),
            "ind_rows": F.expr("coalesce(size(indicators.indicators), 0)"),
            "stats": F.expr("map_values(industry.industry_stats)"),
        }
    )
    return first.withColumns(
        {
            "four": F.expr("shown >= 4"),
            "newest_annual": F.expr("try_element_at(rows, -1)"),
            "newest_year": F.expr("try_element_at(years, -1)"),
            "contiguous": F.expr(
                "coalesce("
                + " and ".join(
                    f"(year(d{i}) * 4 + q{i}.quarter) - (year(d{i + 1}) * 4 + q{i + 1}.quarter) = 1" for i in (1, 2, 3)
                )
                + ", false)"
            ),
            "compared": F.expr("coalesce(size(stats) > 0, false)"),
            "implied": F.expr("market.close * market.total_shares_yi"),
        }
    )


def rules() -> list[Rule]:
    """All rules; the order is the order of the problems."""
    out: list[Rule] = []

    def require(rule_id: str, detail: str, condition: str, when: str = "true") -> None:
        # a requirement that cannot be decided counts as broken
        out.append(Rule(rule_id, "E", detail, f"coalesce({when}, false) and not coalesce({condition}, false)"))

    def warn(rule_id: str, detail: str, condition: str) -> None:
        out.append(Rule(rule_id, "W", detail, f"coalesce({condition}, false)"))

    # identity
    require("DQ1", "stock_info.name", "stock_info.name <> ''")
    require("DQ2", "stock_info.ts_code", "code is not null")
    for section in SECTIONS_WITH_CODE:
        mine = "ts_code" if section in ALWAYS_CODED else f"{section}.ts_code"
        require("DQ3", f"{section}.ts_code", f"{mine} = code")

    # market
    require("DQ4", "market.trade_date", "market.trade_date is not null")
    require("DQ5", "market.close", "abs(market.close) < double('infinity')")
    require("DQ6", "market.total_mv_yi", "abs(market.total_mv_yi) < double('infinity')")
    require("DQ7", "market.trade_date age", "datediff(today, traded) between 0 and 7", "market.trade_date is not null")

    # annual
    require("DQ8", "annual.count", "annual.count >= 1")
    require("DQ9", "annual.count vs rows", "coalesce(annual.count, 0) = size(years)")
    require("DQ10", "annual years unique", "size(array_distinct(years)) = size(years)")
    require("DQ11", "annual years ascending", "array_sort(years) = years")
    require("DQ12", "annual.last_year", "annual.last_year is null or annual.last_year = newest_year", "size(years) > 0")
    require("DQ13", "annual newest year", "newest_year = fy", "size(years) > 0")
    for field in ("revenue_yi", "net_profit_yi"):
        require("DQ14", f"annual newest {field}", f"abs(newest_annual.{field}) < double('infinity')", "size(years) > 0")
    for prefix, field in (("revenue", "revenue_yi"), ("profit", "net_profit_yi")):
        for suffix, horizon in (("full", None), ("5y", 5)):
            declared, again = f"annual.{prefix}_cagr_{suffix}_pct", _growth_again(field, horizon)
            require(
                "DQ15", declared,
                f"({again} is null and {declared} is null) or abs({again} - {declared}) <= 0.15D", "size(years) >= 2",
            )
    warn("DQ16", "annual fewer than 3 years", "annual.count > 0 and annual.count < 3")

    # quarterly
    ocf_full = f"(contiguous and {_known4('ocf_yi')})"
    capex = _known4("capex_yi")
    require("DQ17", "quarterly fewer than 4 quarters", "four")
    for i in FIRST_FOUR:
        number = f"case date_format(d{i}, 'MMdd') when '0331' then 1 when '0630' then 2 when '0930' then 3 when '1231' then 4 end"
        require("DQ18", f"quarterly quarter number {i}", f"({number}) = q{i}.quarter", "four")
    require("DQ19", "quarterly contiguous", "contiguous", "four")
    require("DQ20", "quarterly newest age", "datediff(today, d1) between 0 and 200", "four")
    for field in ("revenue_yi", "net_profit_yi", "ocf_yi"):
        require("DQ21", f"quarterly {field}", _known4(field), "four")
    require("DQ22", "quarterly.ocf_ttm_complete agrees",
            f"coalesce(quarterly.ocf_ttm_complete, false) = coalesce({ocf_full}, false)", "four")
    require("DQ22", "quarterly ocf complete", ocf_full, "four")
    require("DQ23", "quarterly.ocf_ttm_yi", f"abs(quarterly.ocf_ttm_yi - {_sum4('ocf_yi')}) <= 0.05D", f"four and {ocf_full}")
    for i in FIRST_FOUR:
        require("DQ24", f"quarterly fcf {i}", f"abs((q{i}.ocf_yi - q{i}.capex_yi) - q{i}.fcf_yi) <= 0.03D",
                f"four and q{i}.ocf_yi is not null and q{i}.capex_yi is not null")
    require("DQ25", "quarterly.cap_ex_ttm_yi", f"abs(quarterly.cap_ex_ttm_yi - {_sum4('capex_yi')}) <= 0.05D", f"four and {capex}")
    require("DQ25", "quarterly.fcf_ttm_yi", f"abs(quarterly.fcf_ttm_yi - {_sum4('fcf_yi')}) <= 0.05D", f"four and {capex}")
    warn("DQ26", "quarterly capex missing", f"four and not coalesce({capex}, false)")
    warn("DQ26", "quarterly fcf ttm incomplete", f"four and {capex} and not coalesce(quarterly.ttm_complete, false)")
    warn("DQ27", "quarterly inferred basis",
         "exists(quarterly.periods, p -> p.source_statement_kind.income <=> 'inferred_ytd' "
         "or p.source_statement_kind.cashflow <=> 'inferred_ytd')")

    # balance
    require("DQ28", "balance.end_date", "balance.end_date is not null")
    require("DQ29", "balance year", "left(balance.end_date, 4) = string(fy)", "balance.end_date is not null")
    require("DQ30", "balance.total_assets_yi", "abs(balance.total_assets_yi) < double('infinity')")
    require("DQ30", "balance.equity_yi", "abs(balance.equity_yi) < double('infinity')")
    warn("DQ31", "balance.cash_yi", "balance.cash_yi is null")
    warn("DQ32", "balance.goodwill_yi", "balance.goodwill_yi is null")
    warn("DQ33", "balance.interest_debt_yi", "balance.interest_debt_yi is null")

    # indicators
    require("DQ34", "indicators.count", "indicators.count >= 1")
    require("DQ34", "indicators.count vs rows", "coalesce(indicators.count, 0) = ind_rows")
    require("DQ34", "indicators newest year", "newest_ind.year = fy", "ind_rows > 0")
    for field in ("roe_pct", "gross_margin_pct", "net_margin_pct", "debt_ratio_pct"):
        require("DQ34", f"indicators newest {field}", f"abs(newest_ind.{field}) < double('infinity')", "ind_rows > 0")

    # audit
    require("DQ35", "audit.latest", "audit.has_audit and audit.latest.audit_result <> ''")
    require("DQ36", "audit year", "left(audit.latest.end_date, 4) = string(fy)")

    # cross check of units
    require("DQ37", "market.total_mv_yi vs price x shares",
            "abs(market.total_mv_yi - implied) / greatest(abs(implied), 1e-9D) <= 0.05D",
            "market.total_mv_yi is not null and market.close is not null and market.total_shares_yi > 0")

    # peers and the rest
    warn("DQ38", "industry without peers", "not compared")
    require("DQ40", "industry.comparison_fiscal_year", "industry.comparison_fiscal_year = fy", "compared")
    require("DQ40", "industry.comparison_trade_date",
            "coalesce(industry.comparison_trade_date, '') = coalesce(market.trade_date, '')", "compared")
    warn("DQ39", "industry fewer than 5 peers", "compared and exists(stats, s -> s.count < 5)")
    warn("DQ41", "macro", "not coalesce(macro.available, false)")
    warn("DQ42", "annual non_recurring_pct", "exists(rows, r -> r.non_recurring_pct is null)")
    return out


def with_problems(documents: DataFrame, as_of: Column, name: str = "problems") -> DataFrame:
    """The documents plus an array of the broken rules, in rule order."""
    found = ", ".join(
        f"case when {r.broken} then named_struct('rule_id', '{r.rule_id}', 'severity', '{r.severity}', 'detail', '{r.detail}') end"
        for r in rules()
    )
    checked = _named(documents, as_of).withColumn(name, F.expr(f"array_compact(array({found}))").cast(PROBLEM))
    return checked.select(*documents.columns, name)


def status(found: Column) -> Column:
    return (
        F.when(F.exists(found, lambda p: p["severity"] == "E"), "FAIL")
        .when(F.size(found) > 0, "WARN")
        .otherwise("PASS")
    )


def envelope(found: Column) -> Column:
    """The verdict as it is stored with a document."""
    def texts(severity: str) -> Column:
        return F.transform(
            F.filter(found, lambda p: p["severity"] == severity),
            lambda p: F.concat_ws(": ", p["rule_id"], p["detail"]),
        )

    return F.struct(status(found).alias("status"), texts("E").alias("errors"), texts("W").alias("warnings"))


def violations(documents: DataFrame, as_of: Column) -> DataFrame:
    """One row per company and broken rule."""
    found = with_problems(documents, as_of).select("ts_code", "problems")
    return found.select("ts_code", F.inline("problems"))


def verdicts(documents: DataFrame, as_of: Column) -> DataFrame:
    """One row per company: status and number of errors and warnings."""
    found = with_problems(documents, as_of).select("ts_code", "problems")
    p = F.col("problems")
    return found.select(
        "ts_code",
        status(p).alias("status"),
        F.size(F.filter(p, lambda x: x["severity"] == "E")).alias("errors"),
        F.size(F.filter(p, lambda x: x["severity"] == "W")).alias("warnings"),
    )


def with_verdict(documents: DataFrame, as_of: Column, name: str = "data_quality") -> DataFrame:
    """The documents with the stored form of the verdict."""
    checked = with_problems(documents, as_of, "__problems")
    return checked.withColumn(name, envelope(F.col("__problems"))).drop("__problems")


def envelope_problems(declared: Column) -> Column:
    """Is a stored verdict consistent with itself and publishable."""
    status_, errors, warnings = declared["status"], declared["errors"], declared["warnings"]
    checks = [
        ("status", ~F.coalesce(status_.isin("PASS", "WARN"), F.lit(False))),
        ("errors_missing", errors.isNull()),
        ("warnings_missing", warnings.isNull()),
        ("errors_not_empty", F.size(errors) > 0),
        ("pass_with_warnings", (status_ == "PASS") & (F.size(warnings) > 0)),
        ("warn_without_warnings", (status_ == "WARN") & (F.size(F.coalesce(warnings, F.array().cast("array<string>"))) == 0)),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]))


def declared_differs(documents: DataFrame, as_of: Column, declared: str = "data_quality") -> DataFrame:
    """Companies whose stored verdict is not what the rules give now."""
    again = with_verdict(documents, as_of, "recomputed")
    return again.select("ts_code", F.col(declared).alias("declared"), "recomputed").filter(
        ~F.col("declared").eqNullSafe(F.col("recomputed"))
    )
