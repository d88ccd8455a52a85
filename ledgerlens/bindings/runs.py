"""Registered queries: run logs, scores, escalation, universe - and their SQL counterparts.

Events play the run log: their type is the phase, their value decides the
outcome.  A user's events of one week are one run of one company, the number in
``props`` names the analyst role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.bindings import proxy

from ledgerlens.bindings.sqltables import block, code, sql
from ledgerlens.bindings.staging import StagedTables
from ledgerlens.operators import runs, scoring
from ledgerlens.schema import EXPERTS
from ledgerlens.sources import tables as src

QUERIES = {}
ORACLE = {}

# Test weights; tiers and veto rules chosen for the check queries.
RULES = scoring.Scoring(
    weights={
        "financial-auditor": 0.2, "value-valuator": 0.2, "growth-assessor": 0.15, "moat-analyst": 0.15,
        "management-auditor": 0.15, "macro-cyclist": 0.15,
    },
    tiers=(
        scoring.Tier(75, "BUY", 20), scoring.Tier(60, "OBSERVE", 10), scoring.Tier(40, "HOLD", 0), scoring.Tier(0, "AVOID", 0),
    ),
    veto_rules={
        "financial-auditor": ("HOLD", "AVOID"), "management-auditor": ("AVOID",), "macro-cyclist": ("OBSERVE", "HOLD"),
    },
    macro_veto_cap=5.0,
)
CALIBRATION_WEIGHTS = {
    "financial-auditor": 0.25, "value-valuator": 0.25, "moat-analyst": 0.20, "growth-assessor": 0.10,
    "management-auditor": 0.10, "cognitive-controller": 0.05, "macro-cyclist": 0.05,
}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return register


# --- derived tables ------------------------------------------------------------------


def _expert(k: Column) -> Column:
    out = F.lit(None).cast("string")
    for i, e in enumerate(EXPERTS):
        out = F.when(k % len(EXPERTS) == i, e).otherwise(out)
    return out


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxy.raw(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("at"), "user_id", "event_type",
        F.round(F.col("value") * 100).cast("bigint").alias("c"),
        F.get_json_object("props", "$.k").cast("bigint").alias("n"),
    )


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _numbered(spark, sf_dir)
    kind = F.col("event_type")
    phase = (
        F.when(kind == "view", "sync").when(kind == "click", "prompt").when(kind == "purchase", "expert")
        .when(kind == "signup", "report").otherwise("review")
    )
    c = F.col("c")
    status = (
        F.when(c < 500, "start").when(c >= 16000, "crash").when(c >= 12000, "timeout").when(c >= 8000, "error").otherwise("ok")
    )
    return e.select(
        F.col("event_id").alias("seq"), "at", F.col("user_id").cast("string").alias("code"),
        phase.alias("phase"), status.alias("status"),
        F.when(phase == "expert", _expert(F.col("n"))).alias("expert_id"),
        (c * 10).cast("double").alias("duration_ms"), F.concat(kind, F.lit(" "), F.col("n").cast("string")).alias("msg"),
    )


def expert_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _numbered(spark, sf_dir).withColumns({"week": F.date_trunc("week", "at"), "expert_id": _expert(F.col("n"))})
    per = e.groupBy("user_id", "week", "expert_id").agg(
        F.max("c").alias("top"), F.min("c").alias("low"),
        F.max(F.struct("at", "event_id", "event_type"))["event_type"].alias("last_type"),
    )
    home = (
        proxy.raw(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        .join(proxy.raw(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(proxy.raw(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("user_id"), F.col("r_name").alias("industry"))
    )
    last = F.col("last_type")
    return per.join(home, "user_id").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("week", "yyyyMMdd")).alias("run_id"),
        proxy.code_of(F.col("user_id")).alias("ts_code"),
        "industry", F.col("week").alias("created_at"), "expert_id",
        F.least(F.lit(100), F.floor(F.col("top") / 100)).cast("int").alias("score"),
        F.when(F.col("low") < 1000, "VETO").when(F.col("low") < 3000, "WARN").otherwise("PASS").alias("verdict"),
        F.when(last.isin("purchase", "signup", "click"), "POSITIVE").when(last == "error", "NEGATIVE").otherwise("NEUTRAL")
        .alias("conclusion_direction"),
    )


def tables(spark: SparkSession, sf_dir: str) -> StagedTables:
    return StagedTables(spark, sf_dir, {
        "trace_events": lambda: trace_events(spark, sf_dir),
        "expert_results": lambda: expert_results(spark, sf_dir),
    })


block("num", """SELECT event_id, ts AS tt, user_id, event_type, round(value * 100)::BIGINT AS c,
 regexp_extract(props, '(\\d+)', 1)::BIGINT AS n FROM events""")
_EXPERT = "CASE n % 7 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXPERTS)) + " END"
block("ev", f"""SELECT event_id AS seq, tt, user_id::VARCHAR AS code,
 CASE event_type WHEN 'view' THEN 'sync' WHEN 'click' THEN 'prompt' WHEN 'purchase' THEN 'expert' WHEN 'signup' THEN 'report' ELSE 'review' END AS phase,
 CASE WHEN c < 500 THEN 'start' WHEN c >= 16000 THEN 'crash' WHEN c >= 12000 THEN 'timeout' WHEN c >= 8000 THEN 'error' ELSE 'ok' END AS status,
 CASE WHEN event_type = 'purchase' THEN {_EXPERT} END AS expert_id, (c * 10)::DOUBLE AS duration_ms, event_type || ' ' || n AS msg FROM num""", "num")
block("res", f"""SELECT user_id || '-' || strftime(week, '%Y%m%d') AS run_id, {code('user_id')} AS ts_code, r_name AS industry, week AS created_at, expert_id,
 least(100, floor(top / 100.0::DOUBLE))::INTEGER AS score, CASE WHEN low < 1000 THEN 'VETO' WHEN low < 3000 THEN 'WARN' ELSE 'PASS' END AS verdict,
 CASE WHEN last_type IN ('purchase', 'signup', 'click') THEN 'POSITIVE' WHEN last_type = 'error' THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS dir
 FROM (SELECT user_id, date_trunc('week', tt) AS week, {_EXPERT} AS expert_id, max(c) AS top, min(c) AS low,
   arg_max(event_type, (epoch_us(tt)::HUGEINT * 1000000000 + event_id)) AS last_type FROM num GROUP BY ALL)
 JOIN customer ON c_custkey = user_id JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""", "num")


def _ev(spark, sf_dir) -> DataFrame:
    return tables(spark, sf_dir)["trace_events"]


def _res(spark, sf_dir) -> DataFrame:
    return tables(spark, sf_dir)["expert_results"]


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# --- logs ----------------------------------------------------------------------------


@query("run_health", sql("""SELECT phase, count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS error,
 count(*) FILTER (status = 'timeout') AS timeout, count(*) FILTER (status = 'crash') AS crash,
 round(avg(duration_ms) FILTER (duration_ms <> 0), 6) AS mean_duration_ms, count(DISTINCT code) AS codes,
 round(100.0::DOUBLE * count(*) FILTER (status = 'ok') / count(*), 6) AS pass_rate_pct FROM ev WHERE status <> 'start' GROUP BY phase""", "ev"))
def run_health(spark, sf_dir):
    return _r(runs.phase_health(_ev(spark, sf_dir)), "mean_duration_ms", "pass_rate_pct")


@query("expert_health", sql("""SELECT expert_id, count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS error,
 round(avg(duration_ms) FILTER (status = 'ok' AND duration_ms <> 0), 6) AS mean_duration_ms,
 round(100.0::DOUBLE * count(*) FILTER (status = 'ok') / count(*), 6) AS pass_rate_pct
 FROM ev WHERE status <> 'start' AND expert_id IS NOT NULL GROUP BY expert_id""", "ev"))
def expert_health(spark, sf_dir):
    return _r(runs.expert_health(_ev(spark, sf_dir)), "mean_duration_ms", "pass_rate_pct")


@query("recent_failures", sql("""SELECT code, phase, status, msg FROM ev WHERE status IN ('error', 'timeout', 'crash')
 ORDER BY tt DESC, code, phase, msg LIMIT 5""", "ev"))
def recent_failures(spark, sf_dir):
    return runs.recent_failures(_ev(spark, sf_dir)).select("code", "phase", "status", "msg")


@query("phase_durations", sql("""SELECT code, phase, expert_id, CASE WHEN nxt IS NULL THEN 'timeout' ELSE nxt END AS status,
 strftime(tt, '%Y%m%d%H%M%S') AS started_at, round((epoch_us(coalesce(nxt_at, last_at)) - epoch_us(tt)) / 1000.0::DOUBLE)::BIGINT AS duration_ms
 FROM (SELECT code, phase, coalesce(expert_id, '') AS expert_id, status, tt, lead(status) OVER w AS nxt, lead(tt) OVER w AS nxt_at,
   max(tt) OVER (PARTITION BY code) AS last_at FROM ev WINDOW w AS (PARTITION BY code, phase, coalesce(expert_id, '') ORDER BY tt, seq))
 WHERE status = 'start' AND coalesce(nxt, '') <> 'start'""", "ev"))
def phase_durations(spark, sf_dir):
    df = runs.durations(_ev(spark, sf_dir))
    return df.withColumn("started_at", F.date_format("started_at", "yyyyMMddHHmmss"))


@query("daily_digest", sql("""SELECT strftime(tt, '%Y%m%d') AS day, count(*) FILTER (phase = 'report' AND status = 'ok') AS reports,
 count(*) FILTER (status IN ('error', 'timeout', 'crash')) AS failures,
 count(DISTINCT code) FILTER (status IN ('error', 'timeout', 'crash')) AS failed_codes FROM ev GROUP BY 1""", "ev"))
def daily_digest(spark, sf_dir):
    return runs.daily_digest(_ev(spark, sf_dir))


@query("digest_failures", sql("""SELECT strftime(tt, '%Y%m%d') AS day, strftime(tt, '%H:%M:%S') AS clock, code, phase, status, msg FROM ev
 WHERE status IN ('error', 'timeout', 'crash')""", "ev"))
def digest_failures(spark, sf_dir):
    return runs.day_failures(_ev(spark, sf_dir)).select("day", F.date_format("at", "HH:mm:ss").alias("clock"), "code", "phase", "status", "msg")


@query("digest_reports", sql("""SELECT strftime(created_at, '%Y%m%d') AS day, run_id AS code, industry AS name, CASE WHEN industry <> 'EUROPE' THEN max(score)::DOUBLE END AS score,
 CASE WHEN industry <> 'ASIA' THEN min(verdict) END AS rating FROM res GROUP BY created_at, run_id, industry""", "res"))
def digest_reports(spark, sf_dir):
    """Report files of the runs: those of one region state no rating, those of another no number as their score."""
    r = _res(spark, sf_dir).groupBy("created_at", F.col("run_id").alias("code"), "industry").agg(F.max("score").alias("s"), F.min("verdict").alias("v"))
    score = F.when(F.col("industry") == "EUROPE", "n/a").otherwise(F.col("s").cast("string"))
    rating = F.when(F.col("industry") == "ASIA", "").otherwise(F.concat(F.lit('rating: "'), "v", F.lit('"\n')))
    text = F.concat(F.lit("---\n"), F.lit('stock_name: "'), "industry", F.lit('"\ncomposite_score: '), score, F.lit("\n"), rating,
                    F.lit('---\nstock_name: "later"\ncomposite_score: 1\n'))
    return runs.day_reports(r.select("code", F.col("created_at").alias("modified_at"), text.alias("text")))


@query("run_summary", sql("""SELECT CASE WHEN status = 'ok' THEN 'succeeded' ELSE 'failed' END AS outcome, count(*) AS companies
 FROM (SELECT * FROM ev WHERE phase = 'report' QUALIFY row_number() OVER (PARTITION BY code ORDER BY tt DESC, status DESC) = 1) GROUP BY 1""", "ev"))
def run_summary(spark, sf_dir):
    return runs.run_summary(_ev(spark, sf_dir))


@query("event_log", sql("""SELECT code, phase, count(*) AS events, count(*) FILTER (status = 'ok') AS ok,
 count(*) FILTER (status = 'timeout') AS undated FROM ev WHERE status <> 'crash'
 AND (status = 'timeout' OR tt >= TIMESTAMP '2024-01-10') GROUP BY code, phase""", "ev"))
def event_log(spark, sf_dir):
    """The log as JSON lines: crashed events left a torn line, timed out ones an unreadable time."""
    e = _ev(spark, sf_dir)
    stamp = F.when(F.col("status") == "timeout", "n/a").otherwise(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    line = F.to_json(F.struct(stamp.alias("ts"), "code", "phase", "status", "expert_id", "duration_ms", "msg"))
    text = e.select(F.when(F.col("status") == "crash", F.substring(line, 1, 20)).otherwise(line).alias("value"))
    kept = src.events_since(src.parse_events(text), F.lit("2024-01-10T00:00:00Z").cast("timestamp"))
    return kept.groupBy("code", "phase").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("at").isNull()).alias("undated")
    )


# --- scores ----------------------------------------------------------------------------


@query("score_baseline", sql("""SELECT expert_id, count(score) AS n, CASE WHEN count(score) >= 5 THEN round(avg(score), 1) END AS mean,
 CASE WHEN count(score) >= 5 THEN round(stddev_samp(score), 1) END AS std FROM res GROUP BY expert_id""", "res"))
def score_baseline(spark, sf_dir):
    return scoring.baselines(_res(spark, sf_dir))


block("base", "SELECT expert_id, count(score) AS n, round(avg(score), 1) AS mean, round(stddev_samp(score), 1) AS std FROM res GROUP BY 1 HAVING count(score) >= 5", "res")
block("zs", "SELECT r.*, b.n, b.mean, b.std, CASE WHEN b.std > 0 THEN round((r.score - b.mean) / b.std, 2) END AS z FROM res r LEFT JOIN base b ON b.expert_id = r.expert_id", "res", "base")


@query("score_zscore", sql("""SELECT run_id, expert_id, score, z, CASE WHEN z > 1.5 THEN 'high' WHEN z < -1.5 THEN 'low' WHEN z IS NOT NULL THEN 'normal'
 WHEN coalesce(n, 0) < 5 THEN 'insufficient' ELSE 'no_baseline' END AS tag FROM zs""", "zs"))
def score_zscore(spark, sf_dir):
    r = _res(spark, sf_dir)
    return scoring.z_scores(r, scoring.baselines(r)).select("run_id", "expert_id", "score", "z", "tag")


@query("calibrated_totals", sql("SELECT ts_code, run_id, count(score) AS valid, round(sum(score * w), 6) AS raw_total, "
 "round(sum(CASE WHEN z IS NOT NULL THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, 50 + z * 10)) END * w), 6) AS calibrated_total FROM (SELECT *, (CASE expert_id "
 + " ".join(f"WHEN '{e}' THEN {w}" for e, w in CALIBRATION_WEIGHTS.items()) + " END)::DOUBLE AS w FROM zs) GROUP BY ALL", "zs"))
def calibrated_totals(spark, sf_dir):
    r = _res(spark, sf_dir)
    z = scoring.z_scores(r, scoring.baselines(r))
    return _r(scoring.calibrated_totals(z, CALIBRATION_WEIGHTS), "raw_total", "calibrated_total")


_WEIGHT = "(CASE expert_id " + " ".join(f"WHEN '{e}' THEN {w}" for e, w in RULES.weights.items()) + " END)::DECIMAL(6, 4)"
block("comp", f"""SELECT ts_code, run_id, complete, CASE WHEN complete THEN total END AS raw,
 CASE WHEN complete THEN CASE cv WHEN 'VETO' THEN 0.5 WHEN 'WARN' THEN 0.8 ELSE 1.0 END::DECIMAL(4, 2) END AS adjustment
 FROM (SELECT ts_code, run_id, count(DISTINCT expert_id) = 7 AS complete, sum(score * {_WEIGHT}) AS total,
   max(verdict) FILTER (expert_id = 'cognitive-controller') AS cv FROM res GROUP BY ALL)""", "res")


@query("composite_score", sql("SELECT ts_code, run_id, complete, raw::DOUBLE AS raw, adjustment::DOUBLE AS adjustment, (raw * adjustment)::DOUBLE AS adjusted FROM comp", "comp"))
def composite_score(spark, sf_dir):
    return _r(scoring.composite(_res(spark, sf_dir), RULES), "raw", "adjusted")


block("split", """SELECT ts_code, run_id, count(*) FILTER (verdict = 'PASS') AS pass_count, count(*) FILTER (verdict = 'VETO') AS veto_count,
 count(*) FILTER (verdict = 'PASS') > 0 AND count(*) FILTER (verdict = 'VETO') > 0 AND count(*) FILTER (verdict IN ('PASS', 'VETO')) >= 3 AS severe_split
 FROM res GROUP BY ALL""", "res")


@query("verdict_split", sql("SELECT * FROM split", "split"))
def verdict_split(spark, sf_dir):
    return scoring.verdict_split(_res(spark, sf_dir))


block("sgn", "SELECT *, CASE dir WHEN 'POSITIVE' THEN 1 WHEN 'NEGATIVE' THEN -1 ELSE 0 END AS s FROM res", "res")
block("opp", """SELECT *, s * (sum(s) OVER (PARTITION BY run_id) - s) < 0 AS against, count(*) OVER (PARTITION BY run_id) AS roles FROM sgn""", "sgn")
block("new3", """SELECT industry, run_id, row_number() OVER (PARTITION BY industry ORDER BY created_at DESC, run_id DESC) AS pos
 FROM (SELECT DISTINCT industry, run_id, created_at FROM opp WHERE roles = 7) QUALIFY pos <= 3""", "opp")
block("lasting", """SELECT industry, expert_id FROM opp JOIN new3 USING (industry, run_id) WHERE against GROUP BY 1, 2 HAVING count(*) = 3""", "opp", "new3")


@query("industry_opposition", sql("""SELECT n.industry, string_agg(n.run_id, ',' ORDER BY n.pos) AS run_ids,
 coalesce((SELECT string_agg(expert_id, ',' ORDER BY expert_id) FROM lasting l WHERE l.industry = n.industry), '') AS opposed_experts,
 EXISTS (SELECT 1 FROM lasting l WHERE l.industry = n.industry) AS opposition,
 CASE WHEN count(*) >= 3 THEN 'EVALUATED_3_RUNS' ELSE 'INSUFFICIENT_VERIFIED_HISTORY_' || count(*) || '_OF_3' END AS status
 FROM new3 n GROUP BY n.industry""", "new3", "lasting"))
def industry_opposition(spark, sf_dir):
    return scoring.industry_opposition(_res(spark, sf_dir))


@query("escalation", sql("""SELECT s.ts_code, s.run_id, i.industry, s.severe_split, s.pass_count, s.veto_count, round(c.raw * c.adjustment, 2)::DOUBLE AS composite_score,
 coalesce(c.raw * c.adjustment < 40, false) AS score_below_40,
 EXISTS (SELECT 1 FROM lasting l WHERE l.industry = i.industry) AS industry_opposition,
 s.severe_split OR coalesce(c.raw * c.adjustment < 40, false) OR EXISTS (SELECT 1 FROM lasting l WHERE l.industry = i.industry) AS triggered
 FROM split s JOIN comp c USING (ts_code, run_id) JOIN (SELECT DISTINCT run_id, industry FROM res) i ON i.run_id = s.run_id""", "split", "comp", "lasting", "res"))
def escalation(spark, sf_dir):
    return scoring.escalations(_res(spark, sf_dir), RULES)


block("rated", """SELECT c.ts_code, c.run_id, round_even((c.raw * c.adjustment)::DOUBLE, 0) AS score, coalesce(v.vetoes, '') AS vetoes,
 CASE WHEN round_even((c.raw * c.adjustment)::DOUBLE, 0) >= 75 THEN 'BUY' WHEN round_even((c.raw * c.adjustment)::DOUBLE, 0) >= 60 THEN 'OBSERVE'
  WHEN round_even((c.raw * c.adjustment)::DOUBLE, 0) >= 40 THEN 'HOLD' ELSE 'AVOID' END AS tier FROM comp c
 LEFT JOIN (SELECT run_id, string_agg(expert_id, ',' ORDER BY expert_id) AS vetoes FROM res WHERE verdict = 'VETO' GROUP BY 1) v ON v.run_id = c.run_id
 WHERE c.complete""", "comp", "res")
block("ruled", """SELECT *, CASE WHEN vetoes = '' THEN tier
 WHEN vetoes LIKE '%management-auditor%' AND vetoes LIKE '%macro-cyclist%' THEN tier
 WHEN vetoes LIKE '%management-auditor%' THEN 'AVOID'
 WHEN vetoes LIKE '%financial-auditor%' AND vetoes LIKE '%macro-cyclist%' THEN 'HOLD'
 WHEN vetoes LIKE '%financial-auditor%' THEN 'AVOID,HOLD' WHEN vetoes LIKE '%macro-cyclist%' THEN 'HOLD,OBSERVE' ELSE tier END AS a FROM rated""", "rated")
block("allow", "SELECT *, CASE WHEN vetoes <> '' AND a = 'BUY' THEN '' ELSE a END AS allowed FROM ruled", "ruled")
_CAP = """(CASE WHEN allowed LIKE '%BUY%' OR allowed LIKE '%OBSERVE%' THEN
 least(CASE tier WHEN 'BUY' THEN 20 WHEN 'OBSERVE' THEN 10 ELSE 0 END, CASE WHEN vetoes LIKE '%macro-cyclist%' THEN 5 ELSE 100 END) ELSE 0 END)::DOUBLE"""


@query("rating_decision", sql(f"SELECT ts_code, run_id, score, tier AS tier_verdict, vetoes, allowed, {_CAP} AS max_allocation_pct FROM allow", "allow"))
def rating_decision(spark, sf_dir):
    return scoring.ratings(_res(spark, sf_dir), RULES)


@query("decision_audit", sql("""SELECT c.ts_code, c.run_id, u.problem FROM comp c JOIN rated r ON r.run_id = c.run_id JOIN allow a ON a.run_id = c.run_id
 JOIN (SELECT run_id, count(*) FILTER (verdict = 'WARN') AS warns FROM res GROUP BY 1) w ON w.run_id = c.run_id,
 LATERAL (SELECT unnest(list_filter([CASE WHEN warns >= 3 THEN 'composite_score_raw' END,
  CASE WHEN NOT list_contains(string_split(a.allowed, ','), r.tier) THEN 'verdict_not_allowed' END,
  CASE WHEN r.tier = 'BUY' THEN 'buy_without_allocation' END, CASE WHEN r.tier = 'BUY' AND r.vetoes <> '' THEN 'buy_under_veto' END,
  CASE WHEN warns >= 3 THEN 'sub_scores.macro-cyclist' END], lambda x: x IS NOT NULL)) AS problem) u""", "comp", "rated", "allow", "res"))
def decision_audit(spark, sf_dir):
    """Decisions that declare the tier's rating without a position; runs with three warnings misstate some values."""
    r = _res(spark, sf_dir)
    warns = r.groupBy("ts_code", "run_id").agg(F.count_if(F.col("verdict") == "WARN").alias("warns"))
    rated = scoring.ratings(r, RULES)
    role = F.struct(
        F.when((F.col("warns") >= 3) & (F.col("expert_id") == "macro-cyclist"), F.col("score") + 1).otherwise(F.col("score")).alias("score"),
        "verdict",
    )
    sub = r.join(warns, ["ts_code", "run_id"]).groupBy("ts_code", "run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("expert_id", role.alias("v")))).alias("sub_scores")
    )
    declared = (
        scoring.composite(r, RULES).filter("complete").join(rated, ["ts_code", "run_id"])
        .join(warns, ["ts_code", "run_id"]).join(sub, ["ts_code", "run_id"])
    )
    decisions = declared.select(
        "ts_code", "run_id", F.col("tier_verdict").alias("verdict"), F.col("score").alias("composite_score"),
        F.when(F.col("warns") >= 3, F.col("raw") + 1).otherwise(F.col("raw")).alias("composite_score_raw"),
        F.col("adjustment").alias("cognitive_adjustment"), F.filter(F.split("vetoes", ","), lambda x: x != "").alias("vetoes"),
        F.lit(0.0).alias("max_allocation_pct"), "sub_scores",
    )
    return scoring.decision_problems(decisions, r, RULES)


@query("unregistered_reviews", sql("""SELECT ts_code, run_id, 'challenge:' || expert_id AS review_id,
 CASE WHEN dir = 'POSITIVE' THEN 'UPGRADED' ELSE 'DOWNGRADED' END AS verdict FROM res
 WHERE dir <> 'NEUTRAL' AND verdict = 'VETO'""", "res"))
def unregistered_reviews(spark, sf_dir):
    r = _res(spark, sf_dir)
    d = F.col("conclusion_direction")
    view = F.when(d == "POSITIVE", "UPGRADED").when(d == "NEGATIVE", "DOWNGRADED").otherwise("UNCHANGED")
    reviews = r.select("ts_code", "run_id", F.concat(F.lit("challenge:"), "expert_id").alias("review_id"), view.alias("verdict"), F.col("verdict").alias("own"))
    return scoring.unregistered_reviews(reviews, reviews.filter("own <> 'VETO'"))


# --- universe and what is left to do -----------------------------------------------------


def _customers(spark, sf_dir) -> DataFrame:
    c = proxy.raw(spark, sf_dir, "customer")
    plain = F.concat(F.lit("Client "), F.col("c_custkey").cast("string"))
    name = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("*st "), plain)).when(F.col("c_acctbal") < 50, "").otherwise(plain)
    return c.select("c_custkey", proxy.code_of(F.col("c_custkey")).alias("ts_code"), name.alias("name"))


block("cust", f"""SELECT c_custkey, {code('c_custkey')} AS ts_code,
 CASE WHEN c_acctbal < 0 THEN '*st Client ' || c_custkey WHEN c_acctbal < 50 THEN '' ELSE 'Client ' || c_custkey END AS name FROM customer""")
block("univ", "SELECT * FROM cust WHERE name <> '' AND ts_code NOT LIKE '688%' AND ts_code NOT LIKE '8%' AND name NOT ILIKE '%ST%' AND ts_code NOT ILIKE '%ST%'", "cust")


@query("universe", sql("SELECT ts_code, name FROM univ", "univ"))
def universe(spark, sf_dir):
    return runs.investable(_customers(spark, sf_dir)).select("ts_code", "name")


@query("universe_pick", sql("SELECT ts_code, name FROM univ ORDER BY sha256('20010615' || ts_code), ts_code LIMIT 3", "univ"))
def universe_pick(spark, sf_dir):
    return runs.seeded_sample(runs.investable(_customers(spark, sf_dir)).select("ts_code", "name"), 3, "20010615")


def _last_runs(spark, sf_dir) -> DataFrame:
    o = proxy.raw(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.max(F.to_date("o_orderdate")).alias("last_analyzed")).select(
        proxy.code_of(F.col("o_custkey")).alias("ts_code"), "last_analyzed")


_TODAY = "2001-08-02"
block("ready", f"""SELECT u.ts_code, u.name, u.c_custkey AS pos, o.last_analyzed FROM univ u
 LEFT JOIN (SELECT o_custkey, max(o_orderdate::DATE) AS last_analyzed FROM orders GROUP BY 1) o ON o.o_custkey = u.c_custkey
 WHERE o.last_analyzed IS NULL OR date_diff('day', o.last_analyzed, DATE '{_TODAY}') > 5""", "univ")


@query("cooled_down", sql("SELECT ts_code, strftime(last_analyzed, '%Y%m%d') AS last_analyzed FROM ready", "ready"))
def cooled_down(spark, sf_dir):
    pool = runs.investable(_customers(spark, sf_dir))
    out = runs.cooled_down(pool, _last_runs(spark, sf_dir), F.lit(_TODAY).cast("date"))
    return out.select("ts_code", F.date_format("last_analyzed", "yyyyMMdd").alias("last_analyzed"))


@query("rotation_pick", sql("SELECT ts_code, name, pos FROM ready ORDER BY pos < 700, pos LIMIT 1", "ready"))
def rotation_pick(spark, sf_dir):
    pool = runs.investable(_customers(spark, sf_dir)).withColumnRenamed("c_custkey", "pos")
    out = runs.next_in_rotation(pool, _last_runs(spark, sf_dir), 700, F.lit(_TODAY).cast("date"))
    return out.select("ts_code", "name", "pos")


@query("item_choice", sql("""SELECT run_id, expert_id, (('0x' || substr(sha256(run_id || ':' || expert_id), 1, 15))::BIGINT % 7)::BIGINT AS item FROM res""", "res"))
def item_choice(spark, sf_dir):
    r = _res(spark, sf_dir)
    return r.select("run_id", "expert_id", runs.item_choice(F.col("run_id"), F.col("expert_id"), F.lit(7).cast("bigint")).alias("item"))


@query("pending_reports", sql("""SELECT code || strftime(tt, '%m%d') AS ts_code FROM ev WHERE phase = 'prompt' AND status = 'ok'
 EXCEPT SELECT code || strftime(tt, '%m%d') FROM ev WHERE phase = 'report' AND status = 'ok'""", "ev"))
def pending_reports(spark, sf_dir):
    """A company is a user on one day here."""
    e = _ev(spark, sf_dir).filter("status = 'ok'").withColumn("ts_code", F.concat("code", F.date_format("at", "MMdd")))
    return runs.pending(e.filter("phase = 'prompt'"), e.filter("phase = 'report'"))


@query("missing_results", sql("SELECT r.run_id AS ts_code, e.expert_id FROM (SELECT DISTINCT run_id FROM res) r CROSS JOIN (VALUES "
 + ", ".join(f"('{e}')" for e in EXPERTS) + ") e(expert_id) EXCEPT SELECT run_id, expert_id FROM res", "res"))
def missing_results(spark, sf_dir):
    r = _res(spark, sf_dir).select(F.col("run_id").alias("ts_code"), "expert_id")
    return runs.missing_results(r.select("ts_code").distinct(), EXPERTS, r)


@query("scoring_problems")
def scoring_problems(spark, sf_dir):
    """Weights that the score history contradicts in their key set: the check of the rules against the roles that score."""
    seen = _res(spark, sf_dir).select("expert_id").distinct()
    known = spark.createDataFrame([(e,) for e in RULES.weights], "expert_id string")
    unweighted = seen.join(known, "expert_id", "left_anti").select(
        F.concat(F.lit("unweighted:"), "expert_id").alias("problem"))
    return unweighted.unionByName(scoring.scoring_problems(spark, RULES))


