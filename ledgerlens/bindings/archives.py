"""Registered queries: archives, hashes, screening, streaming - and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.bindings import proxy, runs, texts
from ledgerlens.bindings.sqltables import block, sql
from ledgerlens.functions import values as V
from ledgerlens.operators import documents as D
from ledgerlens.operators import integrity as I
from ledgerlens.operators import lines as L
from ledgerlens.operators import screening as X
from ledgerlens.operators import statements as S
from ledgerlens.plans import company as C
from ledgerlens.runtime import shared_dir
from ledgerlens.streaming import run_health as RH

QUERIES = {}
ORACLE = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return register


# --- manifests -------------------------------------------------------------------------------


def _documents(spark, sf_dir) -> DataFrame:
    d = proxy.raw(spark, sf_dir, "documents").join(proxy.raw(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select(
        F.col("source").alias("ts_code"), F.col("lang").alias("run_id"), F.col("doc_id").cast("string").alias("name"), "text",
        F.coalesce("toxic", F.lit(0)).alias("toxic"), F.coalesce("quality", F.lit(1)).alias("quality"), "n_chars",
    )


block("docs", """SELECT source AS ts_code, lang AS run_id, d.doc_id::VARCHAR AS name, text, coalesce(toxic, 0) AS toxic, coalesce(quality, 1) AS quality, n_chars
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")


@query("manifest_audit", sql("""SELECT ts_code, run_id, name, 'missing' AS problem FROM docs WHERE quality = 0 AND toxic = 0
 UNION ALL SELECT ts_code, run_id, name, 'size_differs' FROM docs WHERE toxic = 1 UNION ALL SELECT ts_code, run_id, name, 'hash_differs' FROM docs WHERE toxic = 1
 UNION ALL SELECT ts_code, run_id, name, 'hash_differs' FROM docs WHERE toxic = 0 AND quality = 1 AND text LIKE '%###%'
 UNION ALL SELECT ts_code, run_id, name, 'sha256_malformed' FROM docs WHERE text LIKE '%###%'
 UNION ALL SELECT ts_code, run_id, name, 'duplicate_name' FROM docs WHERE n_chars < 200
 UNION ALL SELECT 'bench', 'x', 'b' || item_id, 'unexpected' FROM benchmark""", "docs"))
def manifest_audit(spark, sf_dir):
    """Manifests over documents: some archived texts changed, some are gone, some entries are malformed or doubled."""
    d = _documents(spark, sf_dir)
    sha = F.sha2("text", 256)
    listed = d.select("ts_code", "run_id", "name", F.when(F.col("text").contains("###"), F.upper(F.concat(F.lit("G"), F.substring(sha, 2, 63)))).otherwise(sha).alias("sha256"),
                      F.octet_length("text").cast("bigint").alias("bytes"), "n_chars")
    manifest = listed.unionByName(listed.filter("n_chars < 200")).drop("n_chars")
    body = F.when(F.col("toxic") == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    files = d.filter("not (quality = 0 and toxic = 0)").select(
        "ts_code", "run_id", "name", F.sha2(body, 256).alias("sha256"), F.octet_length(body).cast("bigint").alias("bytes"))
    extra = proxy.raw(spark, sf_dir, "benchmark").select(
        F.lit("bench").alias("ts_code"), F.lit("x").alias("run_id"), F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("name"),
        F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"))
    return I.manifest_problems(manifest, files.unionByName(extra))


@query("name_differences", sql("""SELECT * FROM (
 SELECT ts_code, run_id, ts_code || '.md' AS name, 'missing' AS difference FROM docs GROUP BY 1, 2 HAVING max(n_chars) <= 5000
 UNION ALL SELECT ts_code, run_id, 'invest_data_' || ts_code || '.json', 'missing' FROM docs GROUP BY 1, 2 HAVING max(toxic) = 0
 UNION ALL SELECT ts_code, run_id, 'note.txt', 'unexpected' FROM docs GROUP BY 1, 2 HAVING min(quality) = 0)""", "docs"))
def name_differences(spark, sf_dir):
    d = _documents(spark, sf_dir)
    expected = I.expected_names(d.select("ts_code", "run_id").distinct(), ["{code}.md", "invest_data_{code}.json"])
    name = F.array_compact(F.array(
        F.when(F.col("n_chars") > 5000, F.concat("ts_code", F.lit(".md"))),
        F.when(F.col("toxic") == 1, F.concat(F.lit("invest_data_"), "ts_code", F.lit(".json"))),
        F.when(F.col("quality") == 0, F.lit("note.txt"))))
    return I.name_differences(expected, d.select("ts_code", "run_id", F.explode(name).alias("name")))


@query("set_hashes", sql("""SELECT ts_code, run_id, sha256(string_agg(br || ':' || d, chr(10) ORDER BY br || ':' || d)) AS set_hash, sum(n)::BIGINT AS files FROM (
 SELECT ts_code, run_id, left(leaf, 2) AS br, sha256(string_agg(leaf || ':' || d, chr(10) ORDER BY leaf || ':' || d)) AS d, sum(n) AS n FROM (
  SELECT ts_code, run_id, left(sha256(name), 4) AS leaf, sha256(string_agg(name || ':' || sha256(text), chr(10) ORDER BY name || ':' || sha256(text))) AS d, count(*) AS n
  FROM docs GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""", "docs"))
def set_hashes(spark, sf_dir):
    files = _documents(spark, sf_dir).select("ts_code", "run_id", "name", F.sha2("text", 256).alias("sha256"))
    return I.set_hash(files, ["ts_code", "run_id"])


_WORDS = " || ".join(f"format('{{:08x}}', (sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT) % 4294967296)::BIGINT)" for i in range(8))


@query("changed_set_hashes", sql(f"""SELECT ts_code, {_WORDS} AS set_hash, count(*) AS files
 FROM (SELECT ts_code, sha256(name || ':' || sha256(text)) AS h FROM docs) GROUP BY 1""", "docs"))
def changed_set_hashes(spark, sf_dir):
    """Hashes kept up: toxic documents came with a text of their own in place of an old one, the rest was there; SQL hashes all anew."""
    by = ["ts_code"]
    now = _documents(spark, sf_dir).select("ts_code", "name", F.sha2("text", 256).alias("sha256"), "toxic")
    toxic = F.col("toxic") == 1
    old = now.withColumn("sha256", F.when(toxic, F.sha2(F.lit("old"), 256)).otherwise(F.col("sha256")))
    return I.changed_hash(I.multiset_hash(old, by), I.multiset_hash(now.where(toxic), by), I.multiset_hash(old.where(toxic), by), by)


@query("batch_ids", sql("""SELECT name, left(sha256(sha256(text) || chr(0) || sha256(ts_code) || chr(0) || sha256(run_id) || chr(0) || '' || chr(0) || sha256(name)), 24) AS batch_id FROM docs""", "docs"))
def batch_ids(spark, sf_dir):
    return _components(spark, sf_dir).select("name", I.batch_id().alias("batch_id"))


def _components(spark, sf_dir) -> DataFrame:
    return _documents(spark, sf_dir).select(
        "name", F.sha2("text", 256).alias("data_hash"), F.sha2("ts_code", 256).alias("annual_hash"), F.sha2("run_id", 256).alias("wiki_hash"),
        F.lit(None).cast("string").alias("prompt_contract_hash"), F.sha2("name", 256).alias("prompt_bundle_hash"), "toxic")


@query("component_mismatches", sql("""SELECT name, 'data_hash' AS field FROM docs WHERE toxic = 1 UNION ALL SELECT name, 'batch_id' FROM docs WHERE toxic = 1""", "docs"))
def component_mismatches(spark, sf_dir):
    """Declared components of toxic documents speak of another text."""
    c = _components(spark, sf_dir)
    now = c.withColumn("batch_id", I.batch_id())
    then = c.withColumn("data_hash", F.when(F.col("toxic") == 1, F.sha2(F.lit("old"), 256)).otherwise(F.col("data_hash")))
    return I.component_mismatches(then.withColumn("batch_id", I.batch_id()), now, ["name"]).select("name", "field")


@query("content_hashes")
def content_hashes(spark, sf_dir):
    m = C.market(proxy.tables(spark, sf_dir), proxy.AS_OF)
    return m.select("ts_code", I.content_hash([c for c in m.columns if c != "ts_code"]).alias("data_hash"))


@query("record_hashes", sql("""SELECT doc_id, sha256(json_object('doc_id', doc_id, 'lang', lang, 'n_chars', n_chars, 'source', source, 'text', text)) AS data_hash
 FROM documents"""))
def record_hashes(spark, sf_dir):
    """Content hash of every given document over all its fields."""
    d = proxy.raw(spark, sf_dir, "documents")
    return d.select("doc_id", I.content_hash(["doc_id", "lang", "n_chars", "source", "text"]).alias("data_hash"))


@query("identity_mismatches", sql("""SELECT run_id AS ts_code, expert_id, 'analysis_date' AS field FROM rd WHERE industry = 'ASIA'
 UNION ALL SELECT run_id, expert_id, 'batch_id' FROM rd WHERE score < 30""", "rd"))
def identity_mismatches(spark, sf_dir):
    f = L.expert_fields(texts.results(spark, sf_dir), texts.KEYS)
    stated = f.select("ts_code", "expert_id", F.col("fm_data_date").alias("data_date"), F.col("fm_analysis_date").alias("analysis_date"), F.col("fm_batch_id").alias("batch_id"))
    return I.identity_mismatches(stated, texts._snapshots(spark, sf_dir), ["ts_code"], ["data_date", "analysis_date", "batch_id"], carry=["expert_id"])


@query("embedded_once", sql("""SELECT run_id AS ts_code, expert_id, CASE WHEN dir = 'NEUTRAL' THEN 0 ELSE 2 END AS times FROM rd WHERE dir = 'NEUTRAL' OR verdict = 'VETO'""", "rd"))
def embedded_once(spark, sf_dir):
    """Drafts that carry vetoing results twice and neutral ones only as a comment."""
    r = texts.results(spark, sf_dir).select("ts_code", "expert_id", "text")
    f = L.expert_fields(r, texts.KEYS)
    body = F.when(F.col("fm_conclusion_direction") == "NEUTRAL", F.concat(F.lit("<!-- "), "text", F.lit(" -->"))).when(
        F.col("fm_verdict") == "VETO", F.concat("text", F.lit("\n"), "text")).otherwise(F.col("text"))
    draft = D.assemble(f.select("ts_code", "expert_id", body.alias("body")), ["ts_code"], ["expert_id"], text="body")
    out = I.embedded_once(draft, r.withColumnRenamed("text", "part"), ["ts_code"], carry=["expert_id"])
    return out.select("ts_code", "expert_id", F.col("times").cast("int").alias("times"))


@query("verified_history", sql("SELECT run_id, industry FROM (SELECT DISTINCT run_id, industry, day FROM rd) WHERE run_id NOT LIKE '2%' AND run_id NOT LIKE '3%'", "rd"))
def verified_history(spark, sf_dir):
    """Stored run records: those of ids from 2 were altered, those of ids from 3 are listed twice."""
    r = texts.results(spark, sf_dir).select(F.col("ts_code").alias("run_id"), "industry", "day").distinct()
    content = F.to_json(F.struct("run_id", "industry", "day"))
    records = r.select("run_id", "industry", F.lit("level3.json").alias("name"),
                       F.when(F.col("run_id").startswith("2"), F.concat(content, F.lit(" "))).otherwise(content).alias("content"))
    manifest = r.select("run_id", F.lit("level3.json").alias("name"), F.sha2(content, 256).alias("sha256"))
    doubled = manifest.unionByName(manifest.filter(F.col("run_id").startswith("3")))
    return I.verified_records(records, doubled, ["run_id"]).select("run_id", "industry")


# --- screening -------------------------------------------------------------------------------

LIMITS = X.Thresholds(
    min_ocf_to_profit_pct=60, max_receivables_to_revenue_pct=60, max_debt_to_cash_pct=200, max_goodwill_to_equity_pct=10,
    clean_opinions=("standard", "emphasis"), min_revenue_cagr_pct=-5, min_profit_cagr_pct=-10, min_roe_pct=2, min_gross_margin_pct=15,
    max_pe=40, max_pb=8,
)
block("np4", f"SELECT ts_code, CASE WHEN count(net_profit) FILTER (pos <= 4) = 4 THEN sum(net_profit) FILTER (pos <= 4) END AS np, "
      "CASE WHEN count(revenue) FILTER (pos <= 4) = 4 THEN sum(revenue) FILTER (pos <= 4) END AS rv FROM shown GROUP BY 1", "shown")
block("streak", """SELECT ts_code, count(*) FILTER (bad = 0)::INTEGER AS g3 FROM (SELECT *, sum(CASE WHEN np > 0 AND top - y = rn - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY ts_code ORDER BY y DESC) AS bad FROM
 (SELECT ts_code, y, max(n_income_attr_p) AS np, max(y) OVER (PARTITION BY ts_code) AS top, row_number() OVER (PARTITION BY ts_code ORDER BY y DESC) AS rn FROM annual GROUP BY ts_code, y)) GROUP BY 1""", "annual")
block("scr", """SELECT m.ts_code, m.trade_date, m.close, m.pe_ttm, m.pb, t.ocf, t.np, t.rv, b.equity, b.accounts_receiv AS ar, b.debt, b.money_cap AS cash,
 b.goodwill / nullif(b.equity, 0) * 100 AS gw, d.audit_result, r.revenue_cagr_5y_pct AS f1, r.profit_cagr_5y_pct AS f2, i.roe, i.gm, s.g3, m.total_share * 1e4 AS shares
 FROM mkt m LEFT JOIN (SELECT ts_code, CASE WHEN contiguous AND NOT has_inferred THEN ocf4 END AS ocf, CASE WHEN contiguous AND NOT has_inferred THEN np END AS np,
  CASE WHEN contiguous AND NOT has_inferred THEN rv END AS rv FROM ttm JOIN np4 USING (ts_code)) t USING (ts_code)
 LEFT JOIN (SELECT * FROM bal3 WHERE pos = 1) b USING (ts_code) LEFT JOIN (SELECT * FROM aud3 WHERE pos = 1) d USING (ts_code) LEFT JOIN rates r USING (ts_code)
 LEFT JOIN (SELECT ts_code, avg(roe) AS roe, max(gross) FILTER (pos = 1) AS gm FROM ind6 WHERE pos <= 5 GROUP BY 1) i USING (ts_code) LEFT JOIN streak s USING (ts_code)""",
 "mkt", "ttm", "np4", "bal3", "aud3", "rates", "ind6", "streak")
block("flags", """SELECT *, NOT coalesce(ocf / nullif(np, 0) * 100 >= 60, false) AS r1_ocf_profit, NOT coalesce(ar / nullif(rv, 0) * 100 <= 60, false) AS r2_ar_revenue,
 NOT coalesce(debt / nullif(cash, 0) * 100 <= 200, false) AS r3_debt_cash, NOT coalesce(coalesce(gw, 0) <= 10, false) AS r4_goodwill,
 NOT coalesce(audit_result IN ('standard', 'emphasis'), false) AS r5_audit, NOT coalesce(ocf > 0, false) AS r6_ocf_pos,
 coalesce(f1 >= -5 AND f2 >= -10 AND roe >= 2 AND gm >= 15 AND pe_ttm BETWEEN 0 AND 40 AND pb BETWEEN 0 AND 8, false) AS good FROM scr""", "scr")


_FLAGS = ("r1_ocf_profit", "r2_ar_revenue", "r3_debt_cash", "r4_goodwill", "r5_audit", "r6_ocf_pos")
_LIMITS = {"f1_rev_cagr": "f1 >= -5", "f2_profit_cagr": "f2 >= -10", "m1_roe_avg": "roe >= 2", "m3_gm": "gm >= 15",
           "v1_pe_ttm": "pe_ttm BETWEEN 0 AND 40", "v2_pb": "pb BETWEEN 0 AND 8"}
block("mrates", """SELECT o_orderdate::DATE AS date, CASE o_orderstatus WHEN 'F' THEN 'cn_10y' ELSE 'us_10y' END AS rate_type,
 sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / count(*) / 5000300.0::DOUBLE AS rate FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2""")
block("scored", "SELECT *, round(100.0::DOUBLE * (" + " + ".join([f"(NOT {f})::INTEGER" for f in _FLAGS] + [f"coalesce({c}, false)::INTEGER" for c in _LIMITS.values()])
      + ") / 12, 2) AS score FROM flags", "flags")


def _rates(spark, sf_dir) -> DataFrame:
    o = proxy.raw(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return o.groupBy(F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") == "F", "cn_10y").otherwise("us_10y").alias("rate_type")).agg(
        (F.sum(cents).cast("double") / F.count(F.lit(1)) / 5000300.0).alias("rate"))


@query("fundamental_screen", sql("""SELECT s.ts_code, """ + ", ".join(_FLAGS) + """, g3 AS g3_profit_streak,
 round(CASE WHEN np > 0 THEN close / nullif(sqrt(22.5::DOUBLE * (np / shares) * (equity / shares)), 0) END, 6) AS g1_graham,
 round(100.0::DOUBLE / nullif(pe_ttm, 0) / nullif(r.rate, 0), 6) AS g2_ey_spread, round(f1, 6) AS f1_rev_cagr, round(f2, 6) AS f2_profit_cagr, round(roe, 6) AS m1_roe_avg,
 round(np / nullif(equity + debt, 0) * 100, 6) AS m2_roic, round(gm, 6) AS m3_gm, round(pe_ttm, 6) AS v1_pe_ttm, round(pb, 6) AS v2_pb, score AS score_total,
 CASE WHEN score >= 80 THEN 'Tier1' WHEN score >= 50 THEN 'Tier2' ELSE 'Tier3' END AS tier,
 CASE WHEN """ + " OR ".join(_FLAGS) + " THEN concat_ws(',', " + ", ".join(f"CASE WHEN {f} THEN '{f}' END" for f in _FLAGS)
 + ") ELSE concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in _LIMITS.items()) + ") END AS reason, "
 + "CASE WHEN " + " OR ".join(_FLAGS) + """ THEN 'PASS' WHEN good THEN 'CANDIDATE' ELSE 'WATCH' END AS result
 FROM scored s ASOF LEFT JOIN (SELECT * FROM mrates WHERE rate_type = 'cn_10y') r ON s.trade_date >= r.date""", "scored", "mrates"))
def fundamental_screen(spark, sf_dir):
    t = {**proxy.tables(spark, sf_dir), "macro_rates": _rates(spark, sf_dir)}
    out = X.screen(X.measures(t, C.day(proxy.AS_OF), "cn_10y"), LIMITS).drop("trade_date")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c[0] in "gfmv" and c != "g3_profit_streak"})


@query("candidate_tracking", sql("""SELECT ts_code, strftime(min(trade_date), '%Y%m%d') AS first_screen_date, strftime(max(trade_date), '%Y%m%d') AS latest_screen_date,
 arg_max(CASE WHEN pb > 4 THEN 'PASS' WHEN pb > 2 THEN 'WATCH' ELSE 'CANDIDATE' END, trade_date) AS rating FROM db GROUP BY ts_code""", "db"))
def candidate_tracking(spark, sf_dir):
    d = proxy.tables(spark, sf_dir)["daily_basic"]
    screens = d.select("ts_code", "trade_date", F.when(F.col("pb") > 4, "PASS").when(F.col("pb") > 2, "WATCH").otherwise("CANDIDATE").alias("result"))
    out = X.candidates(screens)
    return out.withColumns({c: V.ymd(c) for c in ("first_screen_date", "latest_screen_date")})


block("bridge", """SELECT DISTINCT p_brand AS sector_code, y.ts_code, CASE WHEN p_size > 25 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM part
 JOIN lineitem ON l_partkey = p_partkey JOIN (SELECT DISTINCT k, ts_code FROM yb) y ON y.k = l_suppkey""", "yb")


@query("sector_exposure", sql("""SELECT sector_code, count(*) AS companies, sum(weight) AS weight, round(sum(weight * total_mv) / 1e6, 2) AS weighted_mv,
 round(sum(weight * pb) / sum(weight) FILTER (pb IS NOT NULL), 6) AS weighted_pb FROM bridge JOIN mkt USING (ts_code) GROUP BY 1""", "bridge", "mkt"))
def sector_exposure(spark, sf_dir):
    """Brands as themes, suppliers of their parts as members."""
    li = proxy.raw(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    part = proxy.raw(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    bridge = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("sector_code"), proxy.code_of(F.col("l_suppkey")).alias("ts_code"), F.when(F.col("p_size") > 25, 1.0).otherwise(0.5).alias("weight")).distinct()
    market = S.latest_market(proxy.tables(spark, sf_dir)["daily_basic"], C.day(proxy.AS_OF))
    out = X.sector_exposure(bridge, market)
    return out.withColumns({"weighted_mv": F.round(F.col("weighted_mv") / 1e6, 2), "weighted_pb": F.round("weighted_pb", 6)})


@query("risk_free_rate", sql("""SELECT strftime(w.d, '%Y%m%d') AS date, r.rate_type, round(r.rate, 6) AS rate FROM (SELECT DISTINCT d FROM li) w
 ASOF JOIN (SELECT * FROM mrates WHERE rate_type = 'cn_10y') r ON w.d >= r.date""", "li", "mrates"))
def risk_free_rate(spark, sf_dir):
    asked = proxy.raw(spark, sf_dir, "lineitem").select(F.lit("cn_10y").alias("rate_type"), F.to_date("l_shipdate").alias("date"))
    out = X.rate_on(_rates(spark, sf_dir), asked).filter("rate is not null")
    return out.select(V.ymd("date").alias("date"), "rate_type", F.round("rate", 6).alias("rate"))


# --- streaming -------------------------------------------------------------------------------


@query("run_health_stream", sql("""SELECT strftime(date_trunc('day', tt), '%Y%m%d') AS day, phase, count(*) AS total, count(*) FILTER (status = 'ok') AS ok,
 count(*) FILTER (status IN ('error', 'timeout', 'crash')) AS failed, round(avg(duration_ms), 6) AS mean_duration_ms FROM ev WHERE status <> 'start'
 GROUP BY date_trunc('day', tt), phase
 HAVING date_trunc('day', tt) + INTERVAL 1 DAY <= (SELECT max(tt) FROM ev WHERE status <> 'start') - INTERVAL 1 HOUR""", "ev"))
def run_health_stream(spark, sf_dir):
    """The log read as a stream: every day whose window the watermark has closed."""
    log = runs.tables(spark, sf_dir)
    schema = log["trace_events"].schema
    events = RH.log_stream(spark, f"{log.folder}/trace_events", schema)
    out, checkpoint = shared_dir(spark, "stream-out"), shared_dir(spark, "stream-checkpoint")
    RH.append_health(events, out, checkpoint)
    rows = spark.read.schema("day timestamp, phase string, total long, ok long, failed long, mean_duration_ms double").parquet(out)
    return rows.withColumns({"day": F.date_format("day", "yyyyMMdd"), "mean_duration_ms": F.round("mean_duration_ms", 6)})


