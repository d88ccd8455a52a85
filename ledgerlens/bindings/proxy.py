"""Canonical tables derived from the star-schema test tables.

Suppliers play the companies, line items their business.  All gaps (unpublished
quarters, unknown types, missing parts) come from properties of the data, so
they appear at every scale.  Sums are taken over whole cents, hence exact.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.bindings.staging import StagedTables

AS_OF = "2001-06-15"


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_of(key: Column) -> Column:
    """Company code from a numeric key: digits reversed, so leading digits vary."""
    text = key.cast("string")
    symbol = F.reverse(F.lpad(text, F.greatest(F.lit(6), F.length(text)), F.lit("0")))
    head = F.substring(symbol, 1, 1)
    exchange = F.when(head.isin("5", "6", "9"), "SH").when(head.isin("4", "8"), "BJ").otherwise("SZ")
    return F.concat(symbol, F.lit("."), exchange)


def _whole(v: Column) -> Column:
    """The nearest whole number, halves away from zero: ``round`` writes every double out as a decimal first."""
    return F.when(v < 0, -F.floor(F.lit(0.5) - v)).otherwise(F.floor(v + 0.5))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with money in cents and rates in whole percent."""
    li = raw(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("k"),
        F.to_date("l_shipdate").alias("d"),
        _whole(F.col("l_extendedprice") * 100).alias("cents"),
        _whole(F.col("l_discount") * 100).alias("disc"),
        _whole(F.col("l_tax") * 100).alias("tax"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        F.col("l_linenumber").alias("ln"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("st"),
    )


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items by company and year, in one exchange of narrow rows.

    A company has some twenty lines a quarter, spread over all files: sums of one task are hardly fewer than its
    lines, but five times as wide.  So the lines travel, and every sum by company and year is formed behind them.
    """
    return lines(spark, sf_dir).withColumn("y", F.year("d")).repartition("k", "y")


def _sum(expr: str) -> Column:
    return F.sum(F.expr(expr))


def _any(cond: str) -> Column:
    return F.max(F.expr(f"case when {cond} then 1 else 0 end"))


# profit share of a line in percent, by return flag
PROFIT = "cents * (case flag when 'N' then 10 when 'A' then 8 else -12 end)"


def quarter_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per company and quarter with traffic: exact flow sums and the conditions of the gaps."""
    li = dealt(spark, sf_dir).withColumn("q", F.quarter("d"))
    base = li.groupBy("k", "y", "q").agg(
        _sum("cents * (100 - disc)").alias("rev"),
        _sum("cents * 100").alias("gross"),
        _sum(PROFIT).alias("prof"),
        _sum("cents * 80").alias("cogs"),
        _sum("cents * disc").alias("sell"),
        _sum("case when ln = 7 then cents * tax end").alias("rd"),
        _sum("cents * (10 - disc)").alias("oper"),
        _sum("case when qty >= 45 then cents end").alias("nonop"),
        _sum("case when st = 'F' then cents * 9 else cents * 3 end").alias("ocf"),
        _sum("cents * (-tax)").alias("inv"),
        _sum("case when ln <= 3 and tax >= 6 then cents * tax end").alias("capex"),
        F.min("cents").alias("min_cents"),
        F.max("cents").alias("max_cents"),
        F.max("disc").alias("max_disc"),
        F.max("tax").alias("max_tax"),
        F.count(F.lit(1)).alias("n"),
        _any("ln = 1").alias("has1"),
        _any("ln = 2").alias("has2"),
        _any("ln = 4").alias("has4"),
        _any("ln = 5").alias("has5"),
        _any("ln = 6").alias("has6"),
        _any("tax = 0 or tax = 8").alias("typed_i"),
        _any("disc = 0 or disc = 5 or disc = 10").alias("typed_c"),
        _any("qty = 50 and flag = 'R'").alias("extra"),
        _any("qty = 50").alias("warned"),
    )
    year = Window.partitionBy("k", "y").orderBy("q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flows = ("rev", "prof", "cogs", "sell", "rd", "oper", "nonop", "ocf", "inv", "capex")
    ytd = {
        f"{f}_y": F.when(F.col(f).isNotNull(), F.sum(f).over(year)) for f in flows
    }
    end = F.last_day(F.make_date("y", F.col("q") * 3, F.lit(1)))
    return base.withColumns(ytd).withColumns(
        {
            "ts_code": code_of(F.col("k")),
            "end_date": end,
            "ann_date": F.when(F.col("has5") == 1, F.date_add(end, 30)),
            "f_ann_date": F.when(F.col("has6") == 1, F.date_add(end, 45)),
        }
    )


def _money(col: str, unit: float = 1.0) -> Column:
    """Exact integer sum -> yuan; sums carry a factor that makes a company a few hundred _yi big."""
    return F.col(col).cast("double") / F.lit(unit)


KEY = ("ts_code", "ann_date", "f_ann_date", "end_date")


def income(base: DataFrame) -> DataFrame:
    published = base.filter("has1 = 1")
    kind = F.when(F.col("typed_i") == 0, "").when(F.col("has4") == 0, "3").otherwise("1")
    names = dict(
        total_revenue="rev", n_income_attr_p="prof", total_cogs="cogs", sell_exp="sell", rd_exp="rd",
        operate_profit="oper", non_oper_income="nonop",
    )
    ytd = published.select(
        *KEY, kind.alias("report_type"), *[_money(f"{v}_y").alias(n) for n, v in names.items()]
    )
    own = published.filter("extra = 1").select(
        *KEY,
        F.lit("2").alias("report_type"),
        *[_money("gross" if n == "total_revenue" else v).alias(n) for n, v in names.items()],
    )
    return ytd.unionByName(own)


def cashflow(base: DataFrame) -> DataFrame:
    kind = F.when(F.col("typed_c") == 0, "").otherwise("1")
    return base.filter("has2 = 1").select(
        *KEY,
        kind.alias("report_type"),
        _money("ocf_y").alias("n_cashflow_act"),
        _money("inv_y").alias("n_cashflow_inv_act"),
        _money("capex_y").alias("c_pay_acq_const_fiolta"),
    )


def forecast(base: DataFrame) -> DataFrame:
    return base.filter("warned = 1").select(
        "ts_code",
        F.date_sub("end_date", 15).alias("ann_date"),
        "end_date",
        F.when(F.col("prof") > 0, "up").otherwise("down").alias("type"),
        (-F.col("max_disc")).cast("double").alias("p_change_min"),
        F.col("max_tax").cast("double").alias("p_change_max"),
        _money("min_cents", 6.9997).alias("net_profit_min"),
        _money("max_cents", 6.9997).alias("net_profit_max"),
        _money("prof", 69997.0).alias("last_parent_net"),
        F.concat(F.lit("lines "), F.col("n").cast("string")).alias("summary"),
    )


def year_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = dealt(spark, sf_dir).groupBy("k", "y").agg(
        _sum("cents * 100").alias("assets"),
        _sum("cents * (40 + disc)").alias("liab"),
        _sum("cents * (60 - disc)").alias("equity"),
        _sum("case when flag = 'N' and ln <= 3 then cents * 100 end").alias("cash"),
        _sum("case when ln = 1 then cents * 50 end").alias("st"),
        _sum("case when ln = 2 then cents * 50 end").alias("lt"),
        _sum("case when ln = 3 and qty >= 40 then cents * 50 end").alias("bonds"),
        _sum("case when flag = 'R' and qty <= 2 then cents * 100 end").alias("goodwill"),
        _sum("case when flag = 'A' then cents * 100 end").alias("receiv"),
        _sum("case when flag = 'N' then cents * 100 end").alias("stock"),
        _sum("case when qty = 1 then 1 end").alias("ones"),
        _sum("cents * (100 - disc)").alias("rev"),
        _sum("cents * 80").alias("cogs"),
        _sum(PROFIT).alias("prof"),
        _any("flag = 'A' and tax = 8").alias("ann"),
        _any("flag = 'A' and ln = 1").alias("rated"),
    )
    end = F.make_date("y", F.lit(12), F.lit(31))
    return base.withColumns(
        {"ts_code": code_of(F.col("k")), "end_date": end}
    )


def balance(base: DataFrame) -> DataFrame:
    return base.select(
        "ts_code",
        F.when(F.col("ann") == 1, F.date_add("end_date", 60)).alias("ann_date"),
        F.date_add("end_date", 75).alias("f_ann_date"),
        "end_date",
        F.lit("1").alias("report_type"),
        _money("assets").alias("total_assets"),
        _money("liab").alias("total_liab"),
        _money("equity").alias("total_hldr_eqy_exc_min_int"),
        _money("cash").alias("money_cap"),
        _money("st").alias("st_borr"),
        _money("lt").alias("lt_borr"),
        _money("bonds").alias("bonds_payable"),
        _money("goodwill").alias("goodwill"),
        _money("receiv").alias("accounts_receiv"),
        _money("stock").alias("inventories"),
    )


def indicators(base: DataFrame) -> DataFrame:
    def share(a: str, b: str) -> Column:
        return F.col(a).cast("double") / F.col(b).cast("double") * 100

    return base.filter("rated = 1").select(
        "ts_code",
        F.date_add("end_date", 60).alias("ann_date"),
        "end_date",
        share("prof", "equity").alias("roe"),
        ((F.col("rev") - F.col("cogs")).cast("double") / F.col("rev").cast("double") * 100).alias("grossprofit_margin"),
        share("prof", "rev").alias("netprofit_margin"),
        F.when(F.col("ones") >= 1, share("liab", "assets")).alias("debt_to_assets"),
        (F.col("stock").cast("double") / F.col("st").cast("double")).alias("current_ratio"),
    )


def audits(base: DataFrame) -> DataFrame:
    return base.select(
        "ts_code",
        F.date_add("end_date", 60).alias("ann_date"),
        "end_date",
        F.when(F.col("prof") < 0, "qualified").when(F.col("ann") == 0, "emphasis").otherwise("standard").alias("audit_result"),
        _money("rev", 1e2).alias("audit_fees"),
        F.concat(F.lit("agency "), F.col("ones").cast("string")).alias("audit_agency"),
        F.lit(None).cast("string").alias("audit_sign"),
    )


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = raw(spark, sf_dir, "supplier")
    n = raw(spark, sf_dir, "nation")
    r = raw(spark, sf_dir, "region")
    bal = F.col("s_acctbal")
    name = (
        F.when(bal < -400, F.concat(F.lit("*ST "), "s_name"))
        .when(bal < 0, F.concat(F.lit("*st "), "s_name"))
        .when(bal > 9700, F.concat("s_name", F.lit("退")))
        .otherwise(F.col("s_name"))
    )
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    code = code_of(F.col("s_suppkey"))
    return joined.select(
        code.alias("ts_code"),
        F.substring_index(code, ".", 1).alias("symbol"),
        name.alias("name"),
        F.substring_index(code, ".", -1).alias("exchange"),
        F.lit(None).cast("date").alias("list_date"),
        F.when(bal.between(9000, 9200), F.lit("1999-12-31").cast("date")).alias("delist_date"),
        F.col("r_name").alias("industry_sw"),
        F.col("n_name").alias("area"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sums per company and ship date."""
    per = dealt(spark, sf_dir).groupBy("k", "y", "d").agg(
        F.sum("cents").alias("c"),
        F.sum("qty").alias("q"),
        _sum("cents * (2 * tax - disc)").alias("earn"),
        _sum("cents * tax").alias("ct"),
        _sum("cents * (100 + tax)").alias("mv"),
        _sum("cents * (tax - disc)").alias("chg"),
    )
    return per.drop("y").withColumn("ts_code", code_of(F.col("k")))


def daily_basic(day: DataFrame) -> DataFrame:
    close = F.col("c").cast("double") / F.col("q").cast("double") / 99.97  # no short decimals, no rounding ties
    return day.select(
        "ts_code",
        F.col("d").alias("trade_date"),
        close.alias("close"),
        (F.col("c").cast("double") * 100 / F.nullif("earn", F.lit(0)).cast("double")).alias("pe_ttm"),
        (close / 700).alias("pb"),
        (F.col("c").cast("double") * 100 / F.nullif("ct", F.lit(0)).cast("double")).alias("ps_ttm"),
        (F.col("mv").cast("double") * 10 / 0.9997).alias("total_mv"),
        (F.col("q").cast("double") * 1e5).alias("total_share"),
    )


def daily_quotes(day: DataFrame) -> DataFrame:
    per_share = F.col("q").cast("double")
    return day.select(
        "ts_code",
        F.col("d").alias("trade_date"),
        (F.col("c").cast("double") / per_share / 99.97).alias("close"),
        (F.col("chg").cast("double") / per_share / 9997.0).alias("change"),
        F.col("q").cast("double").alias("vol"),
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order volumes as macro series, keyed by order status and priority."""
    o = raw(spark, sf_dir, "orders")
    month = F.date_format("o_orderdate", "yyyyMM")
    name = F.concat(
        F.when(F.col("o_orderstatus") == "F", "m1").when(F.col("o_orderstatus") == "O", "m2").otherwise("pmi_"),
        F.when(F.col("o_orderstatus") == "P", F.substring("o_orderpriority", 1, 1)).otherwise(""),
    )
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    per = o.groupBy(name.alias("indicator"), month.alias("period")).agg(
        F.sum(cents).alias("s"), F.count(F.lit(1)).alias("n")
    )
    # mean price in thousands, around fifty
    value = F.col("s").cast("double") / F.col("n").cast("double") / 5e5
    return per.select("indicator", "period", value.alias("value"), (value / 3).alias("yoy_pct"))


def tables(spark: SparkSession, sf_dir: str) -> StagedTables:
    """The canonical tables of one scale, derived and stored on first use."""
    # the exact sums several tables share are stored as well
    def quarters() -> DataFrame:
        return out["quarter_sums"]

    def years() -> DataFrame:
        return out["year_sums"]

    def days() -> DataFrame:
        return out["day_sums"]

    out = StagedTables(spark, sf_dir, {
        "quarter_sums": lambda: quarter_base(spark, sf_dir),
        "year_sums": lambda: year_base(spark, sf_dir),
        "day_sums": lambda: daily(spark, sf_dir),
        "stocks": lambda: stocks(spark, sf_dir),
        "income": lambda: income(quarters()),
        "cashflow": lambda: cashflow(quarters()),
        "forecast": lambda: forecast(quarters()),
        "balance": lambda: balance(years()),
        "fina_indicators": lambda: indicators(years()),
        "fina_audit": lambda: audits(years()),
        "daily_basic": lambda: daily_basic(days()),
        "daily_quotes": lambda: daily_quotes(days()),
        "macro": lambda: macro(spark, sf_dir),
    }, views=("daily_basic", "daily_quotes"))
    return out
