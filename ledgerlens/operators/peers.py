"""Peer comparison: every company against the others of its industry, in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import values as V
from ledgerlens.operators import orderstats, picks
from ledgerlens.operators.statements import cumulative, visible
from ledgerlens.runtime import materialize

# Compared measures, in report order.
FINANCIAL_METRICS = (
    "roe_pct",
    "gross_margin_pct",
    "net_margin_pct",
    "debt_ratio_pct",
    "sell_expense_rate_pct",
    "rd_expense_rate_pct",
)
RATIO_METRICS = FINANCIAL_METRICS[:4]
VALUATION_METRICS = ("pe_ttm", "pb")
VALUATION_RANGE = (0, 500)  # open interval; values outside are outliers
QUANTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}

GROUP = ("industry", "period", "metric")


@dataclass(frozen=True)
class PeerInputs:
    stocks: DataFrame
    indicators: DataFrame
    income: DataFrame
    daily_basic: DataFrame


def eligible() -> Column:
    """May serve as a peer: not under special treatment, not delisted by name or date."""
    name = F.col("name")
    return ~name.ilike("%ST%") & ~name.contains("退") & F.col("delist_date").isNull()


def companies(stocks: DataFrame) -> DataFrame:
    """Companies with an industry; ``in_pool`` marks those that may be somebody's peer."""
    return stocks.filter(F.coalesce(F.col("industry_sw"), F.lit("")) != "").select(
        "ts_code",
        "name",
        F.col("industry_sw").alias("industry"),
        F.coalesce(eligible(), F.lit(False)).alias("in_pool"),
    )


def _trimmed(x: Column) -> Column:
    low, high = VALUATION_RANGE
    return (x > low) & (x < high)


def _long(df: DataFrame, metrics: tuple[str, ...], *keys: str) -> DataFrame:
    return df.unpivot(list(keys), list(metrics), "metric", "x")


def financial_measures(inputs: PeerInputs, as_of: Column, fiscal_end: Column) -> DataFrame:
    """(ts_code, metric, x) of the six statement measures at one fiscal year end.

    The two statements are never joined: in long form their measures only line
    up below each other.
    """
    ind = visible(inputs.indicators, as_of, f_ann=False).filter(F.col("end_date") == fiscal_end)
    ind = picks.keep_one(ind, ["ts_code"], [F.col("ann_date").desc(), F.col("roe").desc_nulls_last()])
    inc = visible(inputs.income, as_of).filter((F.col("end_date") == fiscal_end) & cumulative())
    inc = picks.keep_one(
        inc,
        ["ts_code"],
        [V.statement_type("report_type").asc_nulls_last(), F.col("ann_date").desc_nulls_last(),
         F.col("total_revenue").desc_nulls_last()],
    )
    ratios = ind.select(
        "ts_code",
        V.finite("roe").alias("roe_pct"),
        V.finite("grossprofit_margin").alias("gross_margin_pct"),
        V.finite("netprofit_margin").alias("net_margin_pct"),
        V.finite("debt_to_assets").alias("debt_ratio_pct"),
    )
    rates = inc.select(
        "ts_code",
        V.pct("sell_exp", "total_revenue").alias("sell_expense_rate_pct"),
        V.pct("rd_exp", "total_revenue").alias("rd_expense_rate_pct"),
    )
    return _long(ratios, FINANCIAL_METRICS[:4], "ts_code").unionByName(_long(rates, FINANCIAL_METRICS[4:], "ts_code"))


def own_dates(inputs: PeerInputs, as_of: Column) -> DataFrame:
    """Companies with their newest trade date (NULL without any quote)."""
    newest = (
        inputs.daily_basic.filter(F.col("trade_date") <= as_of)
        .groupBy("ts_code")
        .agg(F.max("trade_date").alias("own_date"))
    )
    return companies(inputs.stocks).drop("name").join(newest, "ts_code", "left")


def measures(inputs: PeerInputs, as_of: Column) -> DataFrame:
    """All values that take part in a comparison, in long form.

    A group is (industry, period, metric).  The period of a statement measure is
    the fiscal year end, that of a valuation a trade date which is the newest
    one of some company in the industry.  ``in_pool`` rows are peers,
    ``is_target`` rows are what a company is judged by.  The result has a few
    rows per company, is needed several times and therefore gets stored.
    """
    fiscal_end = F.make_date(V.fiscal_year_available(as_of), F.lit(12), F.lit(31))
    own = own_dates(inputs, as_of)
    # every company is a target in every measure, also where its own value is unknown
    asked = companies(inputs.stocks).select(
        "ts_code", "industry", "in_pool", F.explode(F.array(*[F.lit(m) for m in FINANCIAL_METRICS])).alias("metric")
    )
    fin = asked.join(financial_measures(inputs, as_of, fiscal_end), ["ts_code", "metric"], "left").select(
        "ts_code", "industry", fiscal_end.alias("period"), "metric", "x", "in_pool", F.lit(True).alias("is_target")
    )
    wanted = own.filter("own_date is not null").select("industry", F.col("own_date").alias("trade_date")).distinct()
    # dates of a calendar, a few thousand at most: quotes of all other days go before anything is exchanged
    dates = wanted.select("trade_date").distinct()
    traded = (
        inputs.daily_basic.select("ts_code", "trade_date", V.finite("pe_ttm").alias("pe_ttm"), V.finite("pb").alias("pb"))
        .filter(F.col("trade_date") <= as_of)
        .join(F.broadcast(dates), "trade_date", "left_semi")
        .join(own, "ts_code")
        .join(F.broadcast(wanted), ["industry", "trade_date"], "left_semi")
        .withColumn("is_target", F.col("trade_date") == F.col("own_date"))
    )
    val = _long(traded, VALUATION_METRICS, "ts_code", "industry", "trade_date", "in_pool", "is_target").select(
        "ts_code", "industry", F.col("trade_date").alias("period"), "metric", "x", "in_pool", "is_target"
    )
    return materialize(fin.unionByName(val).filter("is_target or (in_pool and x is not null)"), "peer-values")


def _flags(df: DataFrame, trim_rank: bool) -> DataFrame:
    """Does a peer's value count in the statistics, and does it count in the ranking.

    Valuation statistics leave outliers out; the ranking does so for the
    earnings multiple, and for the book multiple only with ``trim_rank``.
    """
    valuation = F.col("metric").isin(*VALUATION_METRICS)
    ranked_trim = valuation if trim_rank else F.col("metric") == "pe_ttm"
    ok = _trimmed(F.col("x"))
    peer = F.col("in_pool") & F.col("x").isNotNull()
    return df.withColumns(
        {
            "in_stats": F.when(peer & (~valuation | ok), 1).otherwise(0).cast("long"),
            "in_rank": F.when(peer & (~ranked_trim | ok), 1).otherwise(0).cast("long"),
        }
    )


def _ranked_values(values: DataFrame) -> DataFrame:
    """Distinct values per group with running counts; a target's value takes part with weight zero."""
    known = values.filter("x is not null")
    counts = known.groupBy(*GROUP, "x").agg(F.sum("in_stats").alias("s"), F.sum("in_rank").alias("r"))
    return orderstats.cumulative_counts(counts, GROUP, "x", ["s", "r"])


def _low(q: float, n: Column) -> Column:
    """Position below the quantile *q* of *n* sorted values when one of them is left out."""
    return F.greatest(F.floor(F.lit(q) * (n - 2)), F.lit(0))


def industry_stats(inputs: PeerInputs, as_of: Column) -> DataFrame:
    """Count, mean and quartiles of every measure over all eligible companies of an industry."""
    values = _flags(measures(inputs, as_of), False).filter("in_stats = 1")
    counts = values.groupBy(*GROUP, "x").agg(F.count(F.lit(1)).alias("s"))
    ranked = orderstats.cumulative_counts(counts, GROUP, "x", ["s"])
    n = F.col("s_total")
    h = {name: F.lit(q) * (n - 1) for name, q in QUANTILES.items()}
    positions = {}
    for name in QUANTILES:
        positions |= {f"{name}_lo": F.floor(h[name]), f"{name}_hi": F.ceil(h[name])}
    return orderstats.group_constants(ranked, GROUP, "x", "s", positions).select(
        *GROUP,
        n.alias("n"),
        (F.col("s_sum") / n).alias("mean"),
        *[
            orderstats.interpolate(F.col(f"{name}_lo"), F.col(f"{name}_hi"), h[name]).alias(name)
            for name in QUANTILES
        ],
    )


def peer_comparison(inputs: PeerInputs, as_of: Column, trim_rank: bool = False, stored: DataFrame | None = None) -> DataFrame:
    """Every company's measures next to the statistics of its peers, itself left out.

    One row per company and measure: own value, number of peers, their mean and
    quartiles, and the share of peers at or below the own value.  Where the own
    value is unknown the peers' statistics stand alone.  ``stored`` takes the
    result of ``measures`` when the caller has it already.

    No company is ever paired with another.  Leaving one value out moves a
    quantile position by less than one place, so three neighbouring order
    statistics per group and quantile answer it for every member.
    """
    values = _flags(measures(inputs, as_of) if stored is None else stored, trim_rank)
    ranked = _ranked_values(values)
    n = F.col("s_total")
    positions = {f"{name}_{k}": _low(q, n) + k for name, q in QUANTILES.items() for k in range(3)}
    constants = orderstats.group_constants(ranked, GROUP, "x", "s", positions)
    placed = (
        values.filter("is_target")
        .join(ranked.select(*GROUP, "x", "r_upto", "r_total"), [*GROUP, "x"], "left")
        .join(constants, list(GROUP), "left")
    )
    x = F.col("x")
    m = F.coalesce(n, F.lit(0)) - F.col("in_stats")

    def without_self(name: str, q: float) -> Column:
        first = _low(q, n)
        v = F.array(*[F.col(f"{name}_{k}") for k in range(3)])

        def at(position: Column) -> Column:
            slot = (position - first + 1).cast("int")
            here = F.try_element_at(v, slot)
            # removing the own value moves everything from it on one place down
            return F.when((F.col("in_stats") == 1) & (x <= here), F.try_element_at(v, slot + 1)).otherwise(here)

        h = F.lit(q) * (m - 1)
        return F.when(m > 0, orderstats.interpolate(at(F.floor(h)), at(F.ceil(h)), h))

    others = F.col("r_total") - F.col("in_rank")
    return placed.select(
        "ts_code",
        *GROUP,
        x.alias("value"),
        m.alias("n"),
        F.when(m > 0, (F.col("s_sum") - F.when(F.col("in_stats") == 1, x).otherwise(0.0)) / m).alias("mean"),
        *[without_self(name, q).alias(name) for name, q in QUANTILES.items()],
        # without statistics there is no ranking either
        F.when((m > 0) & (others > 0), (F.col("r_upto") - F.col("in_rank")) / others * 100).alias("rank_pct"),
    ).filter("value is not null or n > 0")


def peer_coverage(inputs: PeerInputs, as_of: Column, stored: DataFrame | None = None) -> DataFrame:
    """Per company: how many peers there are, and how many have statement or valuation measures."""
    own = own_dates(inputs, as_of)
    pool_size = own.groupBy("industry").agg(F.sum(F.col("in_pool").cast("long")).alias("pool_size"))

    def has(metrics: tuple[str, ...]) -> Column:
        return F.max(F.col("metric").isin(*metrics).cast("long"))

    # one row per company and period, then one per industry and period
    values = measures(inputs, as_of) if stored is None else stored
    per = values.filter("x is not null").groupBy("ts_code", "industry", "period", "in_pool", "is_target").agg(
        has(RATIO_METRICS).alias("fin"), has(VALUATION_METRICS).alias("val")
    )
    peers = per.filter("in_pool").groupBy("industry", "period").agg(F.sum("fin").alias("fin"), F.sum("val").alias("val"))
    fin = peers.filter("fin > 0").select("industry", F.col("fin").alias("fin_n"))
    val = peers.filter("val > 0").select("industry", F.col("period").alias("own_date"), F.col("val").alias("val_n"))
    mine = per.filter("in_pool and is_target").groupBy("ts_code").agg(
        F.max("fin").alias("own_fin"), F.max("val").alias("own_val")
    )
    joined = (
        own.join(mine, "ts_code", "left")
        .join(pool_size, "industry")
        .join(fin, "industry", "left")
        .join(val, ["industry", "own_date"], "left")
    )

    def without_me(total: str, me: str) -> Column:
        return F.coalesce(F.col(total), F.lit(0)) - F.coalesce(F.col(me), F.lit(0))

    return joined.select(
        "ts_code",
        "industry",
        F.col("own_date").alias("trade_date"),
        (F.col("pool_size") - F.col("in_pool").cast("long")).alias("peer_count"),
        without_me("fin_n", "own_fin").alias("financial_peer_rows"),
        without_me("val_n", "own_val").alias("market_peer_rows"),
    )
