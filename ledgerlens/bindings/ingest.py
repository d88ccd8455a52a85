"""Registered queries: vendor frames, merging, replacing, planning - and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.bindings import proxy
from ledgerlens.bindings.sqltables import AS_OF, block, sql
from ledgerlens.functions import values as V
from ledgerlens.plans import company as C
from ledgerlens.sources import ingest as G
from ledgerlens.sources import tables as src

QUERIES = {}
ORACLE = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return register


def _on():
    return C.day(proxy.AS_OF)


def _t(spark, sf_dir):
    return proxy.tables(spark, sf_dir)


# --- values ----------------------------------------------------------------------------

_SYMBOL = "reverse(lpad(c_custkey::VARCHAR, greatest(6, length(c_custkey::VARCHAR))::INTEGER, '0'))"
block("syms", f"""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN ' ' || {_SYMBOL} || '.sh ' WHEN c_acctbal > 9500 THEN {_SYMBOL} || 'X'
 WHEN c_acctbal > 9000 THEN NULL ELSE {_SYMBOL} END AS raw, c_acctbal FROM customer""")


def _symbols(spark, sf_dir) -> DataFrame:
    c = proxy.raw(spark, sf_dir, "customer")
    symbol = F.substring_index(proxy.code_of(F.col("c_custkey")), ".", 1)
    bal = F.col("c_acctbal")
    text = (
        F.when(bal < 0, F.concat(F.lit(" "), symbol, F.lit(".sh "))).when(bal > 9500, F.concat(symbol, F.lit("X")))
        .when(bal > 9000, F.lit(None).cast("string")).otherwise(symbol)
    )
    return c.select("c_custkey", text.alias("raw"))


@query("code_normalization", sql("""SELECT c_custkey, raw, ts_code, ts_code IS NULL AS rejected, split_part(ts_code, '.', 1) AS symbol, split_part(ts_code, '.', 2) AS exchange
 FROM (SELECT c_custkey, raw, CASE WHEN c_acctbal > 9000 THEN NULL WHEN c_acctbal < 0 THEN upper(trim(raw))
  WHEN left(raw, 1) IN ('5', '6', '9') THEN raw || '.SH' WHEN left(raw, 1) IN ('0', '1', '2', '3') THEN raw || '.SZ'
  WHEN left(raw, 1) IN ('4', '8') THEN raw || '.BJ' END AS ts_code FROM syms)""", "syms"))
def code_normalization(spark, sf_dir):
    df = _symbols(spark, sf_dir).withColumn("ts_code", V.normalize_code("raw"))
    return df.select("c_custkey", "raw", "ts_code", F.col("ts_code").isNull().alias("rejected"),
                     V.code_symbol("ts_code").alias("symbol"), V.code_exchange("ts_code").alias("exchange"))


@query("date_shapes", """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE strftime(o_orderdate, '%Y%m%d') END AS compact,
 CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS hyphen,
 CASE WHEN o_orderpriority <> '5-LOW' THEN strftime(o_orderdate, '%Y%m%d') END AS day,
 CASE WHEN o_orderpriority <> '5-LOW' AND month(o_orderdate) % 3 = 0 AND o_orderdate::DATE = last_day(o_orderdate) THEN month(o_orderdate) // 3 END AS quarter,
 CASE WHEN o_orderpriority <> '5-LOW' THEN year(o_orderdate) - CASE WHEN month(o_orderdate) >= 5 THEN 1 ELSE 2 END END AS fiscal_year FROM orders""")
def date_shapes(spark, sf_dir):
    o = proxy.raw(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderpriority") == "5-LOW", "").when(F.col("o_orderstatus") == "F", F.date_format(d, "yyyy-MM-dd"))
        .when(F.col("o_orderstatus") == "O", F.date_format(d, "yyyy/MM/dd HH:mm")).otherwise(F.date_format(d, "yyyyMMdd"))
    )
    day = V.as_date("text")
    return o.select("o_orderkey", text.alias("text")).select(
        "o_orderkey", V.compact_date("text").alias("compact"), V.hyphen_date("text").alias("hyphen"), V.ymd(day).alias("day"),
        V.quarter_no(day).alias("quarter"), V.fiscal_year_available(day).alias("fiscal_year"),
    )


@query("vendor_numbers", """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN NULL ELSE round(o_totalprice, 2) END AS number,
 CASE o_orderstatus WHEN 'P' THEN NULL ELSE round(round(o_totalprice, 2) / 10000, 6) END AS wan FROM orders""")
def vendor_numbers(spark, sf_dir):
    o = proxy.raw(spark, sf_dir, "orders")
    shown = F.format_number("o_totalprice", 2)
    text = F.when(F.col("o_orderstatus") == "P", F.when(F.col("o_orderpriority") == "5-LOW", "NaN").otherwise("--")).otherwise(
        F.when(F.col("o_orderstatus") == "O", F.concat(shown, F.lit("%"))).otherwise(shown))
    plain = F.regexp_replace("text", "%", "")
    return o.select("o_orderkey", text.alias("text")).select(
        "o_orderkey", V.vendor_number("text").alias("number"), F.round(V.wan_from_yuan(plain), 6).alias("wan"))


# --- vendor frames -----------------------------------------------------------------------


def _grouped(name: str):
    return F.format_number(F.col(name), 0)


def _vendor(frame: DataFrame, table: str, headings, numbers: list[str]) -> DataFrame:
    """A vendor's frame over four years in the layout of a canonical table."""
    period = G.find_date_column(frame.drop("ts_code"))
    dated = G.dated_between(frame, period, F.lit("1997-01-01").cast("date"), F.lit("2000-12-31").cast("date"))
    out = src.align(G.harmonize(dated, headings, keep=["ts_code", "end_date"]), table)
    return out.select("ts_code", V.ymd("end_date").alias("end_date"), *numbers)


@query("vendor_income", sql("""SELECT ts_code, strftime(end_date, '%Y%m%d') AS end_date, rev_y::DOUBLE AS total_revenue, cogs_y::DOUBLE AS total_cogs,
 prof_y::DOUBLE AS n_income_attr_p, NULL::DOUBLE AS rd_exp FROM qb WHERE end_date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31'""", "qb"))
def vendor_income(spark, sf_dir):
    """A second vendor's statement: own headings, text numbers, the period under a heading of its own."""
    frame = _t(spark, sf_dir)["quarter_sums"].select(
        "ts_code", F.date_format("end_date", "yyyy-MM-dd").alias("报告日"), _grouped("rev_y").alias("营业总收入"),
        _grouped("cogs_y").alias("营业总成本"), _grouped("prof_y").alias("归属于母公司股东的净利润"), F.lit("--").alias("研发费用"),
    )
    return _vendor(frame, "income", G.INCOME_HEADINGS, ["total_revenue", "total_cogs", "n_income_attr_p", "rd_exp"])


_SPAN = "end_date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31'"


@query("vendor_balance", sql(f"""SELECT ts_code, strftime(end_date, '%Y%m%d') AS end_date, assets::DOUBLE AS total_assets, cash::DOUBLE AS money_cap,
 goodwill::DOUBLE AS goodwill, stock::DOUBLE AS total_nca, st::DOUBLE AS total_cur_liab, lt::DOUBLE AS total_noncur_liab, nullif(ones, 0)::DOUBLE AS total_share,
 NULL::DOUBLE AS bonds_payable FROM yb WHERE {_SPAN}""", "yb"))
def vendor_balance(spark, sf_dir):
    """Balance sheet with the period under a heading that says nothing: its first column is taken by its values."""
    frame = _t(spark, sf_dir)["year_sums"].select(
        "ts_code", F.date_format("end_date", "yyyyMMdd").alias("x"), _grouped("assets").alias("资产总计"), _grouped("cash").alias("货币资金"),
        _grouped("goodwill").alias("商誉"), _grouped("stock").alias("非流动资产合计"), _grouped("st").alias("流动负债合计"),
        _grouped("lt").alias("非流动负债合计"), F.col("ones").cast("string").alias("实收资本(或股本)"), F.lit("--").alias("应付债券"),
    )
    return _vendor(frame, "balance", G.BALANCE_HEADINGS, ["total_assets", "money_cap", "goodwill", "total_nca", "total_cur_liab",
                                                          "total_noncur_liab", "total_share", "bonds_payable"])


@query("vendor_cashflow", sql(f"""SELECT ts_code, strftime(end_date, '%Y%m%d') AS end_date, ocf_y::DOUBLE AS n_cashflow_act, inv_y::DOUBLE AS n_cashflow_inv_act,
 coalesce(capex_y, n)::DOUBLE AS c_pay_acq_const_fiolta, NULL::DOUBLE AS free_cash_flow FROM qb WHERE {_SPAN}""", "qb"))
def vendor_cashflow(spark, sf_dir):
    """Cash flow whose capital spending stands under either of two headings."""
    frame = _t(spark, sf_dir)["quarter_sums"].select(
        "ts_code", F.date_format("end_date", "yyyy-MM-dd").alias("报告期"), _grouped("ocf_y").alias("经营活动产生的现金流量净额"),
        _grouped("inv_y").alias("投资活动产生的现金流量净额"), _grouped("capex_y").alias("购建固定资产、无形资产和其他长期资产支付的现金"),
        F.col("n").cast("string").alias("购建固定资产、无形资产及其他长期资产支付的现金"),
    )
    return _vendor(frame, "cashflow", G.CASHFLOW_HEADINGS, ["n_cashflow_act", "n_cashflow_inv_act", "c_pay_acq_const_fiolta", "free_cash_flow"])


@query("vendor_indicators", sql(f"""SELECT ts_code, strftime(end_date, '%Y%m%d') AS end_date, (prof * 100 // equity)::DOUBLE AS roe, (liab * 100 // assets)::DOUBLE AS debt_to_assets,
 nullif(ones, 0)::DOUBLE AS current_ratio, (prof // 100)::DOUBLE AS ocf_to_profit FROM yb WHERE prof >= 0 AND {_SPAN}""", "yb"))
def vendor_indicators(spark, sf_dir):
    """Indicators written with percent signs."""
    percent = lambda e: F.concat(F.expr(e).cast("string"), F.lit("%"))
    frame = _t(spark, sf_dir)["year_sums"].where("prof >= 0").select(
        "ts_code", F.date_format("end_date", "yyyy-MM-dd").alias("报告期"), percent("prof * 100 div equity").alias("净资产收益率"),
        percent("liab * 100 div assets").alias("资产负债率"), F.col("ones").cast("string").alias("流动比率"),
        F.format_number(F.expr("prof div 100"), 0).alias("每股经营现金流"),
    )
    return _vendor(frame, "fina_indicators", G.INDICATOR_HEADINGS, ["roe", "debt_to_assets", "current_ratio", "ocf_to_profit"])


@query("vendor_quotes", sql("""SELECT ts_code, strftime(trade_date, '%Y%m%d') AS trade_date, round(close, 4) AS close, round(change, 4) AS change, vol,
 round(close - change, 2) AS pre_close FROM quotes""", "quotes"))
def vendor_quotes(spark, sf_dir):
    """Daily quotes under the vendor's headings; the close before follows from close and change."""
    q = _t(spark, sf_dir)["daily_quotes"]
    frame = q.select("ts_code", F.date_format("trade_date", "yyyy-MM-dd").alias("日期"), F.col("close").cast("string").alias("收盘"),
                     F.col("change").cast("string").alias("涨跌额"), _grouped("vol").alias("成交量"))
    dated = frame.withColumn("trade_date", V.as_date(F.col(G.find_date_column(frame.drop("ts_code")))))
    out = G.harmonize(dated, G.QUOTE_HEADINGS, keep=["ts_code", "trade_date"])
    out = src.align(out.withColumn("pre_close", V.rounded(F.col("close") - F.col("change"))), "daily_quotes")
    return out.select("ts_code", V.ymd("trade_date").alias("trade_date"), F.round("close", 4).alias("close"), F.round("change", 4).alias("change"), "vol", "pre_close")


@query("company_rows", sql("SELECT ts_code, name, industry AS industry_sw, area FROM stocks", "stocks"))
def company_rows(spark, sf_dir):
    s = _t(spark, sf_dir)["stocks"]
    pairs = s.select("ts_code", F.explode(F.create_map(
        F.lit("股票简称"), "name", F.lit("行业"), "industry_sw", F.lit("地域"), "area")).alias("item", "value"))
    return G.company_row(pairs).select("ts_code", "name", "industry_sw", "area")


@query("companies_from_quotes", sql(f"""SELECT ts_code, symbol, exchange FROM (SELECT c_custkey, raw AS symbol, CASE WHEN left(raw, 1) IN ('5', '6', '9') THEN 'SH'
  WHEN left(raw, 1) IN ('0', '1', '2', '3') THEN 'SZ' WHEN left(raw, 1) IN ('4', '8') THEN 'BJ' END AS exchange,
  raw || '.' || CASE WHEN left(raw, 1) IN ('5', '6', '9') THEN 'SH' WHEN left(raw, 1) IN ('0', '1', '2', '3') THEN 'SZ' WHEN left(raw, 1) IN ('4', '8') THEN 'BJ' END AS ts_code
  FROM syms WHERE length(raw) = 6) WHERE exchange IS NOT NULL""", "syms"))
def companies_from_quotes(spark, sf_dir):
    q = _symbols(spark, sf_dir).withColumn("name", F.col("c_custkey").cast("string"))
    return G.companies_from_quotes(q, "raw", "name").select("ts_code", "symbol", "exchange")


@query("valuation_stamp", sql(f"""SELECT s.ts_code, strftime(q.trade_date, '%Y%m%d') AS trade_date, round(q.close, 6) AS close, s.name FROM stocks s JOIN
 (SELECT * FROM quotes WHERE trade_date BETWEEN {AS_OF} - 14 AND {AS_OF} QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) = 1) q
 ON q.ts_code = s.ts_code""", "stocks", "quotes"))
def valuation_stamp(spark, sf_dir):
    t = _t(spark, sf_dir)
    at = F.lit(f"{proxy.AS_OF} 17:30:00").cast("timestamp")
    out = G.date_quote_snapshot(t["stocks"].select("ts_code", "name"), t["daily_quotes"], at, _on())
    return out.select("ts_code", V.ymd("trade_date").alias("trade_date"), F.round("close", 6).alias("close"), "name")


@query("quote_columns", sql("""SELECT ts_code, strftime(trade_date, '%Y%m%d') AS trade_date, round(close - change, 2) AS pre_close FROM quotes""", "quotes"))
def quote_columns(spark, sf_dir):
    q = _t(spark, sf_dir)["daily_quotes"]
    return q.select("ts_code", V.ymd("trade_date").alias("trade_date"), V.pre_close("close", "change").alias("pre_close"))


# --- merging -----------------------------------------------------------------------------


@query("fallback_merge", sql("""SELECT ts_code, strftime(end_date, '%Y%m%d') AS end_date, coalesce(report_type, '') AS report_type, 'primary' AS source FROM income WHERE ts_code LIKE '%.SH'
 UNION ALL SELECT ts_code, strftime(end_date, '%Y%m%d'), coalesce(report_type, ''), 'secondary' FROM income WHERE ts_code NOT LIKE '%.SH'""", "income"))
def fallback_merge(spark, sf_dir):
    inc = _t(spark, sf_dir)["income"]
    merged = G.first_source({"primary": inc.filter(F.col("ts_code").endswith(".SH")), "secondary": inc}, ["ts_code"])
    return merged.select("ts_code", V.ymd("end_date").alias("end_date"), "report_type", "source")


block("reports", """SELECT source AS ts_code, (1995 + n_chars % 6)::INTEGER AS report_year,
 CASE lang WHEN 'en' THEN 'annual' WHEN 'fr' THEN 'semi-annual' WHEN 'es' THEN 'q3' ELSE 'q1' END AS report_type,
 CASE WHEN text LIKE '%###%' THEN NULL ELSE make_date((1996 + n_chars % 6)::INTEGER, 4, (1 + n_chars % 28)::INTEGER) END AS ann_date,
 'S' || doc_id AS section_name, text AS section_text, doc_id, lang FROM documents""")


def reports(spark, sf_dir) -> DataFrame:
    """Documents as report sections: the source is the company, the language the kind of report."""
    d = proxy.raw(spark, sf_dir, "documents")
    lang = F.col("lang")
    year = (1995 + F.col("n_chars") % 6).cast("int")
    return d.select(
        F.col("source").alias("ts_code"), year.alias("report_year"),
        F.when(lang == "en", "annual").when(lang == "fr", "semi-annual").when(lang == "es", "q3").otherwise("q1").alias("report_type"),
        F.when(~F.col("text").contains("###"), F.make_date(year + 1, F.lit(4), (1 + F.col("n_chars") % 28).cast("int"))).alias("ann_date"),
        F.concat(F.lit("report "), year.cast("string")).alias("title"),
        F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("section_name"),
        F.col("text").alias("section_text"), "doc_id", "lang",
    )


@query("text_fallback", sql("""SELECT section_name, ts_code, report_year, source FROM (SELECT *, CASE lang WHEN 'en' THEN 'secondary' WHEN 'fr' THEN 'primary' ELSE 'cache' END AS source,
 min(CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END) OVER (PARTITION BY ts_code, report_year) AS best FROM reports)
 WHERE best = CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END""", "reports"))
def text_fallback(spark, sf_dir):
    r = reports(spark, sf_dir)
    out = G.best_text(
        {"primary": r.filter("lang = 'fr'"), "secondary": r.filter("lang = 'en'"), "cache": r.filter("lang not in ('fr', 'en')")},
        ["ts_code", "report_year"])
    return out.select("section_name", "ts_code", "report_year", "source")


@query("legacy_columns", sql("""SELECT ts_code, strftime(end_date, '%Y%m%d') AS end_date, audit_result, audit_fees, NULL::VARCHAR AS audit_sign FROM audits""", "audits"))
def legacy_columns(spark, sf_dir):
    """Old rows carry the opinion under its former name, new rows under the present one."""
    a = _t(spark, sf_dir)["fina_audit"].drop("audit_sign")
    old = a.filter("year(end_date) < 1998").withColumnsRenamed({"audit_result": "opinion_type", "audit_fees": "audit_costs"})
    merged = G.carry_legacy(old.unionByName(a.filter("year(end_date) >= 1998"), allowMissingColumns=True))
    out = src.align(G.add_missing(merged, {"audit_sign": "string"}), "fina_audit")
    return out.select("ts_code", V.ymd("end_date").alias("end_date"), "audit_result", "audit_fees", "audit_sign")


@query("upsert_daily", sql("""SELECT ts_code, strftime(trade_date, '%Y%m%d') AS trade_date, round(CASE WHEN trade_date >= DATE '2001-05-01' THEN close * 2 ELSE close END, 6) AS close
 FROM db WHERE trade_date < DATE '2001-06-01' OR ts_code LIKE '%.SZ'""", "db"))
def upsert_daily(spark, sf_dir):
    """Stored rows up to June; a restated May arrives for everyone, June for one exchange; the last arrival counts."""
    d = _t(spark, sf_dir)["daily_basic"].select("ts_code", "trade_date", "close")
    june = F.lit("2001-06-01").cast("date")
    stored = d.filter(F.col("trade_date") < june)
    batch = d.filter(F.col("trade_date") >= F.lit("2001-05-01").cast("date")).filter((F.col("trade_date") < june) | F.col("ts_code").endswith(".SZ"))
    twice = batch.withColumn("arrival", F.lit(1)).unionByName(batch.withColumns({"close": F.col("close") * 2, "arrival": F.lit(2)}))
    out = G.upsert(stored, twice, ["ts_code", "trade_date"], [F.col("arrival")])
    return out.select("ts_code", V.ymd("trade_date").alias("trade_date"), F.round("close", 6).alias("close"))


@query("replace_statements", sql("""SELECT ts_code, strftime(end_date, '%Y%m%d') AS end_date, coalesce(report_type, '') AS report_type,
 CASE WHEN ts_code LIKE '%.SH' THEN 2 * total_revenue ELSE total_revenue END AS total_revenue FROM income
 WHERE ts_code NOT LIKE '%.SH' OR year(end_date) >= 1999""", "income"))
def replace_statements(spark, sf_dir):
    """One exchange delivers its newer years again, in two versions; its older rows go."""
    inc = _t(spark, sf_dir)["income"].select("ts_code", "end_date", "report_type", "total_revenue")
    batch = inc.filter(F.col("ts_code").endswith(".SH") & (F.year("end_date") >= 1999)).withColumn("version", F.lit(1))
    both = batch.unionByName(batch.withColumns({"total_revenue": F.col("total_revenue") * 2, "version": F.lit(2)}))
    out = G.replace_companies(inc, both, ["ts_code", "end_date", "report_type"], [F.col("version")])
    return out.select("ts_code", V.ymd("end_date").alias("end_date"), "report_type", "total_revenue")


@query("refresh_companies", sql("SELECT ts_code, name || '!' AS name FROM stocks", "stocks"))
def refresh_companies(spark, sf_dir):
    s = _t(spark, sf_dir)["stocks"].select("ts_code", "name").withColumn("arrival", F.lit(1))
    again = s.withColumns({"name": F.concat("name", F.lit("!")), "arrival": F.lit(2)})
    return G.refresh_companies(s.unionByName(again), [F.col("arrival")]).select("ts_code", "name")


@query("replace_sections", sql("""SELECT ts_code, report_year, report_type, section_name, length(section_text) AS chars FROM reports WHERE report_type <> 'annual'
 UNION ALL SELECT ts_code, report_year, report_type, section_name, 4 FROM reports WHERE report_type = 'annual' AND length(section_text) > 500
 UNION ALL SELECT ts_code, report_year, report_type, section_name, length(section_text) FROM reports r WHERE report_type = 'annual' AND NOT EXISTS
  (SELECT 1 FROM reports x WHERE x.ts_code = r.ts_code AND x.report_year = r.report_year AND x.report_type = 'annual' AND length(x.section_text) > 500)""", "reports"))
def replace_sections(spark, sf_dir):
    """Annual reports come again with their long sections only, shortened; the other sections of those reports go."""
    r = reports(spark, sf_dir).select("ts_code", "report_year", "report_type", "section_name", "section_text")
    batch = r.filter((F.col("report_type") == "annual") & (F.length("section_text") > 500)).withColumns({"section_text": F.lit("text"), "v": F.lit(1)})
    key = ["ts_code", "report_year", "report_type"]
    out = G.replace_companies(r, batch, [*key, "section_name"], [F.col("v")], by=key)
    return out.select(*key, "section_name", F.length("section_text").alias("chars"))


# --- planning ------------------------------------------------------------------------------


@query("sync_plan", sql(f"""SELECT s.ts_code, strftime(d.last_trade, '%Y%m%d') AS last_trade, strftime(i.last_period, '%Y%m%d') AS last_period,
 coalesce(date_diff('day', d.last_trade, DATE '2001-11-06') > 1, true) AS daily_stale, coalesce(date_diff('day', i.last_period, DATE '2001-11-06') > 120, true) AS statements_stale,
 strftime(CASE WHEN coalesce(date_diff('day', d.last_trade, DATE '2001-11-06') > 1, true) THEN coalesce(d.last_trade, DATE '2001-11-06' - 3650) END, '%Y%m%d') AS daily_from,
 strftime(CASE WHEN coalesce(date_diff('day', i.last_period, DATE '2001-11-06') > 120, true) THEN DATE '2001-11-06' - 3650 END, '%Y%m%d') AS statements_from
 FROM stocks s LEFT JOIN (SELECT ts_code, max(trade_date) AS last_trade FROM db GROUP BY 1) d ON d.ts_code = s.ts_code
 LEFT JOIN (SELECT ts_code, max(end_date) AS last_period FROM income GROUP BY 1) i ON i.ts_code = s.ts_code""", "stocks", "db", "income"))
def sync_plan(spark, sf_dir):
    t = _t(spark, sf_dir)
    out = G.sync_plan(t["stocks"], t["daily_basic"], t["income"], F.lit("2001-11-06").cast("date"))
    return out.withColumns({c: V.ymd(c) for c in ("last_trade", "last_period", "daily_from", "statements_from")})


@query("statement_gate", sql("""SELECT ts_code, sum(n)::BIGINT AS rows, count(*) = 5 AS complete, array_to_string(list_filter(['income', 'balance', 'cashflow', 'fina_indicators', 'fina_audit'],
 lambda x: NOT list_contains(list(tab), x)), ',') AS missing FROM (
 SELECT ts_code, 'income' AS tab, count(*) AS n FROM income WHERE year(end_date) = 2000 AND report_type = '2' GROUP BY 1 UNION ALL
 SELECT ts_code, 'balance', count(*) FROM balance WHERE year(end_date) = 2000 AND goodwill IS NOT NULL GROUP BY 1 UNION ALL
 SELECT ts_code, 'cashflow', count(*) FROM cashflow WHERE year(end_date) = 2000 GROUP BY 1 UNION ALL
 SELECT ts_code, 'fina_indicators', count(*) FROM ind WHERE year(end_date) = 2000 AND debt IS NOT NULL GROUP BY 1 UNION ALL
 SELECT ts_code, 'fina_audit', count(*) FROM audits WHERE year(end_date) = 2000 AND audit_result = 'standard' GROUP BY 1) GROUP BY ts_code""",
 "income", "balance", "cashflow", "ind", "audits"))
def statement_gate(spark, sf_dir):
    """A delivery for one year in which every table lacks some companies."""
    t = _t(spark, sf_dir)
    year = "year(end_date) = 2000"
    return G.statement_gate({
        "income": t["income"].filter(year + " and report_type = '2'"),
        "balance": t["balance"].filter(year + " and goodwill is not null"),
        "cashflow": t["cashflow"].filter(year),
        "fina_indicators": t["fina_indicators"].filter(year + " and debt_to_assets is not null"),
        "fina_audit": t["fina_audit"].filter(year + " and audit_result = 'standard'"),
    })


block("spans", "SELECT ts_code || '-' || lang AS ts_code, report_year, section_text FROM reports", "reports")
block("loaded", """SELECT ts_code, report_year FROM spans WHERE length(trim(section_text)) >= 200 GROUP BY ALL HAVING sum(length(section_text)) >= 1000""", "spans")


@query("text_gap_plan", sql("""SELECT c.ts_code, y AS report_year FROM (SELECT DISTINCT ts_code FROM spans) c CROSS JOIN range(1996, 2001) t(y)
 LEFT JOIN loaded l ON l.ts_code = c.ts_code AND l.report_year = y
 WHERE l.ts_code IS NULL AND (y = 2000 OR (SELECT count(*) FROM loaded h WHERE h.ts_code = c.ts_code AND h.report_year BETWEEN 1996 AND 2000)
  + (SELECT count(*) FROM range(1996, 2001) u(z) WHERE z > y AND NOT EXISTS (SELECT 1 FROM loaded m WHERE m.ts_code = c.ts_code AND m.report_year = z)) < 3)""", "spans", "loaded"))
def text_gap_plan(spark, sf_dir):
    r = reports(spark, sf_dir).withColumn("ts_code", F.concat_ws("-", "ts_code", "lang"))
    return G.text_gaps(r.select("ts_code").distinct(), G.loaded_years(r), F.lit(2000))




@query("rows_written", sql("""SELECT 'income' AS table_name, ts_code, count(*) AS rows_written FROM income GROUP BY 2
 UNION ALL SELECT 'balance', ts_code, count(*) FROM balance GROUP BY 2 UNION ALL SELECT 'daily_basic', ts_code, count(*) FROM db GROUP BY 2""", "income", "balance", "db"))
def rows_written(spark, sf_dir):
    t = _t(spark, sf_dir)
    return G.rows_written({n: t[n] for n in ("income", "balance", "daily_basic")})

