"""Screening on fundamentals, candidate tracking, sector exposure, risk-free rates.

Only the columns of these results are given; their thresholds are the caller's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import values as V
from ledgerlens.operators import statements as S


@dataclass(frozen=True)
class Thresholds:
    min_ocf_to_profit_pct: float
    max_receivables_to_revenue_pct: float
    max_debt_to_cash_pct: float
    max_goodwill_to_equity_pct: float
    clean_opinions: tuple[str, ...]
    min_revenue_cagr_pct: float
    min_profit_cagr_pct: float
    min_roe_pct: float
    min_gross_margin_pct: float
    max_pe: float
    max_pb: float
    #: Least scores of the first and the second tier; everything below is the third.
    tiers: tuple[float, float] = (80.0, 50.0)


def measures(tables, as_of: Column, rate_type: str | None = None) -> DataFrame:
    """The measured values of the screen, one row per company; unknown stays NULL.

    Return on invested capital is the trailing profit over equity and interest-bearing debt.  The earnings
    yield is set against the newest rate of ``rate_type`` on the trade day; without a type it is unknown.
    """
    quarters = S.trailing_year(S.single_quarters(tables["income"], tables["cashflow"], as_of))
    ttm = quarters.select(
        "ts_code", "ocf_ttm",
        F.when(~F.col("has_inferred"), S.four_quarter_sum(F.col("periods"), "net_profit")).alias("profit_ttm"),
        F.when(~F.col("has_inferred"), S.four_quarter_sum(F.col("periods"), "revenue")).alias("revenue_ttm"),
    )
    bal = S.balance_history(tables["balance"], as_of, 1).select(
        "ts_code", "equity", "cash", "interest_debt", "accounts_receiv", "goodwill_ratio_pct"
    )
    opinion = S.audit_history(tables["fina_audit"], as_of, 1).select("ts_code", "audit_result")
    market = S.latest_market(tables["daily_basic"], as_of).select(
        "ts_code", "trade_date", "close", "pe_ttm", "pb", (F.col("total_share") * 1e4).alias("shares")
    )
    growth = S.annual_growth(tables["income"], as_of).select("ts_code", "revenue_cagr_5y_pct", "profit_cagr_5y_pct")
    recent = S.indicator_history(tables["fina_indicators"], as_of, 5).groupBy("ts_code").agg(
        F.avg("roe_pct").alias("m1_roe_avg"), F.max(F.when(F.col("pos") == 1, F.col("gross_margin_pct"))).alias("m3_gm")
    )
    out = market
    for part in (ttm, bal, opinion, growth, recent, profit_streak(tables["income"], as_of)):
        out = out.join(part, "ts_code", "left")
    graham = F.sqrt(22.5 * (F.col("profit_ttm") / F.col("shares")) * (F.col("equity") / F.col("shares")))
    out = out.withColumns(
        {
            "ocf_profit_pct": V.ratio_pct("ocf_ttm", "profit_ttm"),
            "ar_revenue_pct": V.ratio_pct("accounts_receiv", "revenue_ttm"),
            "debt_cash_pct": V.ratio_pct("interest_debt", "cash"),
            "m2_roic": V.ratio_pct(F.col("profit_ttm"), F.col("equity") + F.col("interest_debt")),
            "g2_ey_spread": F.lit(None).cast("double"),
            "g1_graham": F.when(F.col("profit_ttm") > 0, F.try_divide("close", graham)),
        }
    )
    if rate_type is not None:
        asked = out.select(F.lit(rate_type).alias("rate_type"), F.col("trade_date").alias("date"))
        rates = rate_on(tables["macro_rates"].filter(F.col("rate_type") == rate_type), asked)
        out = out.join(rates.select(F.col("date").alias("trade_date"), "rate"), "trade_date", "left")
        out = out.withColumn("g2_ey_spread", F.try_divide(F.try_divide(F.lit(100.0), F.col("pe_ttm")), F.col("rate")))
    return out


def profit_streak(income: DataFrame, as_of: Column) -> DataFrame:
    """Years in a row, back from the newest, with a positive profit."""
    years = S.annual_rows(income, as_of).groupBy("ts_code", "year").agg(F.max("n_income_attr_p").alias("p"))
    back = Window.partitionBy("ts_code").orderBy(F.col("year").desc())
    good = F.coalesce((F.col("p") > 0) & (F.first("year").over(back) - F.col("year") == F.row_number().over(back) - 1), F.lit(False))
    broken = years.withColumn("bad", (~good).cast("int")).withColumn("bad_so_far", F.sum("bad").over(back))
    return broken.groupBy("ts_code").agg(F.count_if(F.col("bad_so_far") == 0).cast("int").alias("g3_profit_streak"))


def screen(measured: DataFrame, limits: Thresholds) -> DataFrame:
    """Red flags (False = passed; unknown is a flag) and the outcome.

    A flagged company is passed over (PASS); a clean one that meets every
    growth, margin and price limit is a CANDIDATE, else on WATCH.  The score is
    the share of the twelve checks that are met, in percent, and decides the tier;
    the reason names the flags, or where there are none the limits that are not met.
    """
    def flag(ok: Column) -> Column:
        return ~F.coalesce(ok, F.lit(False))

    flags = {
        "r1_ocf_profit": flag(F.col("ocf_profit_pct") >= limits.min_ocf_to_profit_pct),
        "r2_ar_revenue": flag(F.col("ar_revenue_pct") <= limits.max_receivables_to_revenue_pct),
        "r3_debt_cash": flag(F.col("debt_cash_pct") <= limits.max_debt_to_cash_pct),
        "r4_goodwill": flag(F.coalesce(F.col("goodwill_ratio_pct"), F.lit(0.0)) <= limits.max_goodwill_to_equity_pct),
        "r5_audit": flag(F.col("audit_result").isin(*limits.clean_opinions)),
        "r6_ocf_pos": flag(F.col("ocf_ttm") > 0),
    }
    out = measured.withColumns(flags)
    clean = ~F.greatest(*[F.col(f) for f in flags])
    met = {
        "f1_rev_cagr": F.col("revenue_cagr_5y_pct") >= limits.min_revenue_cagr_pct,
        "f2_profit_cagr": F.col("profit_cagr_5y_pct") >= limits.min_profit_cagr_pct,
        "m1_roe_avg": F.col("m1_roe_avg") >= limits.min_roe_pct,
        "m3_gm": F.col("m3_gm") >= limits.min_gross_margin_pct,
        "v1_pe_ttm": F.col("pe_ttm").between(0, limits.max_pe),
        "v2_pb": F.col("pb").between(0, limits.max_pb),
    }
    missed = {name: flag(ok) for name, ok in met.items()}
    good = ~F.greatest(*missed.values())
    checks = [F.col(f) for f in flags] + list(missed.values())
    score = F.round(100.0 * sum((~c).cast("int") for c in checks) / len(checks), 2)

    def named(raised: dict[str, Column]) -> Column:
        return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in raised.items()])), ",")

    result = F.when(~clean, "PASS").when(good, "CANDIDATE").otherwise("WATCH")
    first, second = limits.tiers
    return out.select(
        "ts_code", "trade_date", *flags, "g1_graham", "g2_ey_spread", "g3_profit_streak",
        F.col("revenue_cagr_5y_pct").alias("f1_rev_cagr"), F.col("profit_cagr_5y_pct").alias("f2_profit_cagr"),
        "m1_roe_avg", "m2_roic", "m3_gm", F.col("pe_ttm").alias("v1_pe_ttm"), F.col("pb").alias("v2_pb"),
        score.alias("score_total"),
        F.when(score >= first, "Tier1").when(score >= second, "Tier2").otherwise("Tier3").alias("tier"),
        F.when(clean, named(missed)).otherwise(named({f: F.col(f) for f in flags})).alias("reason"), result.alias("result"),
    )


def candidates(screens: DataFrame) -> DataFrame:
    """First and newest day a company was screened, with its newest outcome."""
    return screens.groupBy("ts_code").agg(
        F.min("trade_date").alias("first_screen_date"),
        F.max("trade_date").alias("latest_screen_date"),
        F.max(F.struct("trade_date", "result"))["result"].alias("rating"),
    )


def sector_exposure(bridge: DataFrame, market: DataFrame) -> DataFrame:
    """Weighted market value and book multiple per sector; a company counts with its weight."""
    w = F.coalesce(F.col("weight"), F.lit(1.0))
    return bridge.join(market, "ts_code").groupBy("sector_code").agg(
        F.count(F.lit(1)).alias("companies"),
        F.sum(w).alias("weight"),
        F.sum(w * F.col("total_mv")).alias("weighted_mv"),
        (F.sum(w * F.col("pb")) / F.sum(F.when(F.col("pb").isNotNull(), w))).alias("weighted_pb"),
    )


def rate_on(rates: DataFrame, wanted: DataFrame) -> DataFrame:
    """For every wanted (rate_type, date) the newest rate on or before the date.

    Only distinct dates enter the ordered step, so its size is that of a
    calendar; callers join the result back by date.
    """
    asked = wanted.select("rate_type", "date").distinct()
    marks = rates.select("rate_type", "date", "rate", F.lit(0).alias("asked")).unionByName(
        asked.select("rate_type", "date", F.lit(None).cast("double").alias("rate"), F.lit(1).alias("asked"))
    )
    line = Window.partitionBy("rate_type").orderBy("date", "asked").rowsBetween(Window.unboundedPreceding, 0)
    filled = marks.withColumn("rate", F.last("rate", ignorenulls=True).over(line))
    return filled.filter("asked = 1").drop("asked")
