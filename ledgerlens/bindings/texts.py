"""Registered queries: reports as data, claims against facts, contracts - and their SQL counterparts.

Analyst results and company reports are written by Spark from the derived
tables, with faults that follow from the data, so what the audit must find is
known from the data as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.bindings import fundamentals, ingest, proxy, runs
from ledgerlens.bindings.sqltables import block, sql
from ledgerlens.bindings.staging import StagedTables
from ledgerlens.functions import values as V
from ledgerlens.operators import claims as K
from ledgerlens.operators import contract as C
from ledgerlens.operators import documents as D
from ledgerlens.operators import lines as L
from ledgerlens.operators import scoring
from ledgerlens.plans import snapshot

QUERIES = {}
ORACLE = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return register


# --- analyst results -----------------------------------------------------------------------

# One text line per entry, in SQL both engines read.  A NULL entry leaves its line out.
_RESULT_LINES = [
    "'---'",
    "'expert_id: \"' || expert_id || '\"'",
    "'ts_code: ' || run_id",
    "'score: ' || CASE WHEN verdict = 'WARN' AND score >= 90 THEN 'n/a' ELSE CAST(score AS STRING) END",
    "'verdict: ' || verdict",
    "CASE WHEN verdict = 'VETO' AND score >= 40 THEN 'veto_triggers: [debt, \"cash\"]' ELSE 'veto_triggers: []' END",
    "'conclusion_direction: ' || dir",
    "'data_date: ' || day",
    "'analysis_date: ' || day",
    "'batch_id: ' || CASE WHEN score < 30 THEN 'stale' ELSE run_id END",
    "'---'",
    "''",
    "'## 总体判断'",
    "repeat('判断', score * 6)",
    "CASE WHEN verdict = 'VETO' AND dir <> 'NEGATIVE' THEN '⛔ VETO 已触发' ELSE '未触发 ⛔ VETO' END",
    "'## 详细分析'",
    "'PE 9.5 [source: market.pe_ttm]'",
    "'市值 100亿 [source: market.total_mv_yi]'",
    "CASE WHEN score >= 50 THEN 'PB 1.5 [calc: a/b; inputs: market.close, market.pb]' END",
    "'## 叙事–数据交叉验证'",
    "'| # | 论述 | 字段 | 结论 |'",
    "'|---|---|---|---|'",
    "'| 1 | “长期投入” | market.close | 一致 |'",
    "CASE WHEN score >= 20 THEN '| 2 | “稳定增长” | market.pb | 一致 |' END",
    "CASE WHEN score >= 60 THEN '| 3 | “现金充裕” | balance.cash_yi | 一致 |' ELSE '| 3 | 待填写 | | |' END",
    "'## 关键风险与不确定性'",
    "'## 必检项执行记录'",
    "'| 必检项 | 状态 | 证据 | 结论 |'",
    "'|---|---|---|---|'",
    "'| 应收账款检查 | ' || CASE WHEN score >= 50 THEN 'DONE' ELSE 'MISSING' END || ' | `balance.accounts_receiv_yi` | 应收账款平稳可控 |'",
    "'| 商誉减值分析 | DONE | `balance.goodwill_yi` | ' || CASE WHEN verdict = 'VETO' THEN '一句话结论' ELSE '商誉占比很低' END || ' |'",
    "'| 现金流核对 OCF | DONE | ' || CASE WHEN dir = 'NEUTRAL' THEN '口头说明' ELSE '`quarterly.ocf_ttm_yi`' END || ' | OCF 与利润匹配 |'",
    "CASE WHEN dir <> 'NEUTRAL' THEN '## 数据使用说明' END",
    "'## 知识检索日志'",
    "'| # | 页面 | 用途 |'",
    "'|---|---|---|'",
    "'| 1 | `valuation` | 框架 |'",
    "'| 2 | wiki:moat.md | 框架 |'",
    "CASE WHEN score >= 60 THEN '| 3 | cycle | 周期 |' ELSE '| 3 | absent | 周期 |' END",
]
_RESULT_TEXT = f"concat_ws(chr(10), {', '.join(_RESULT_LINES)})"


#: Results of one task.  A few bytes of a score make a long text, so tasks are cut by rows, not by the bytes of a file.
RESULTS_A_TASK = 5_000


def result_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Partitions by run in which ``results`` lie."""
    return max(1, -(-runs.tables(spark, sf_dir)["expert_results"].count() // RESULTS_A_TASK))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analyst result document per run and role; the run id stands for the company code.

    Runs are dealt as narrow rows and the texts are made behind the exchange, so what follows by run or by document stays in the task.
    """
    r = runs.tables(spark, sf_dir)["expert_results"].withColumnsRenamed({"conclusion_direction": "dir"})
    r = r.repartition(result_tasks(spark, sf_dir), "run_id").withColumn("day", F.date_format("created_at", "yyyyMMdd"))
    return r.select(F.col("run_id").alias("ts_code"), "expert_id", F.expr(_RESULT_TEXT).alias("text"), "industry", "day")


block("rd", f"SELECT *, {_RESULT_TEXT} AS text FROM (SELECT *, strftime(created_at, '%Y%m%d') AS day FROM res)", "res")

CHECKLIST = [("应收账款检查", [["receiv"]]), ("商誉减值分析", [["goodwill"]]), ("现金流核对 OCF", [["ocf"], ["quarterly", "annual"]])]


def checklist(spark: SparkSession) -> DataFrame:
    from ledgerlens.schema import EXPERTS

    rows = [(e, item, groups) for e in EXPERTS for item, groups in CHECKLIST]
    return spark.createDataFrame(rows, "expert_id string, item string, token_groups array<array<string>>")


KEYS = ["ts_code", "expert_id"]


@query("front_matter", sql("""SELECT run_id AS ts_code, expert_id, expert_id AS fm_expert_id, run_id AS fm_ts_code,
 CASE WHEN verdict = 'WARN' AND score >= 90 THEN NULL ELSE score END AS fm_score, verdict AS fm_verdict, dir AS fm_conclusion_direction,
 day AS fm_data_date, CASE WHEN score < 30 THEN 'stale' ELSE run_id END AS fm_batch_id,
 CASE WHEN verdict = 'VETO' AND score >= 40 THEN 'debt,cash' ELSE '' END AS triggers FROM rd""", "rd"))
def front_matter(spark, sf_dir):
    f = L.expert_fields(results(spark, sf_dir), KEYS)
    return f.select(*KEYS, "fm_expert_id", "fm_ts_code", "fm_score", "fm_verdict", "fm_conclusion_direction", "fm_data_date",
                    "fm_batch_id", F.array_join("fm_veto_triggers", ",").alias("triggers"))


@query("composite_from_text", sql("""SELECT ts_code, run_id, complete AND NOT torn AS complete, CASE WHEN NOT torn THEN raw::DOUBLE END AS raw FROM comp JOIN
 (SELECT run_id AS r, bool_or(verdict = 'WARN' AND score >= 90) AS torn FROM res GROUP BY 1) ON r = run_id""", "comp", "res"))
def composite_from_text(spark, sf_dir):
    """Scores read from the documents themselves; one that is no integer leaves the run without a total."""
    f = L.expert_fields(results(spark, sf_dir), KEYS).select(
        F.col("ts_code").alias("run_id"), "expert_id", F.col("fm_score").alias("score"), F.col("fm_verdict").alias("verdict"))
    codes = runs.tables(spark, sf_dir)["expert_results"].select("run_id", "ts_code").distinct()
    return scoring.composite(f.join(codes, "run_id"), runs.RULES).select("ts_code", "run_id", "complete", "raw")


def _snapshots(spark, sf_dir) -> DataFrame:
    """What the results of a run have to agree with; one industry was analysed on another day."""
    r = results(spark, sf_dir).select("ts_code", "industry", "day").distinct()
    return r.select("ts_code", F.col("day").alias("data_date"), F.col("ts_code").alias("batch_id"),
                    F.when(F.col("industry") == "ASIA", "19990101").otherwise(F.col("day")).alias("analysis_date"))


_R = {
    "R3": "length(trim(text)) < 1200", "R9": "verdict = 'WARN' AND score >= 90", "R11": "verdict = 'VETO' AND score < 40",
    "R12": "verdict = 'VETO' AND dir = 'NEGATIVE'", "R15": "score < 30", "R16": "industry = 'ASIA'", "R17": "dir = 'NEUTRAL'", "R20": "score < 50",
}


@query("result_contract", sql(" UNION ALL ".join(f"SELECT run_id AS ts_code, expert_id, '{r}' AS rule_id FROM rd WHERE {c}" for r, c in _R.items()), "rd"))
def result_contract(spark, sf_dir):
    return D.result_problems(results(spark, sf_dir).select(*KEYS, "text"), _snapshots(spark, sf_dir))


block("cl", """SELECT run_id AS ts_code, expert_id, '应收账款检查' AS item, CASE WHEN score >= 50 THEN 'DONE' ELSE 'MISSING' END AS status, score >= 50 AS found FROM res
 UNION ALL SELECT run_id, expert_id, '商誉减值分析', 'DONE', verdict <> 'VETO' FROM res
 UNION ALL SELECT run_id, expert_id, '现金流核对 OCF', 'DONE', dir <> 'NEUTRAL' FROM res""", "res")
block("cs", """SELECT ts_code, expert_id, count(*) AS total, count(*) FILTER (found) AS covered, count(*) FILTER (found) AS done,
 round(100.0::DOUBLE * count(*) FILTER (found) / count(*), 1) AS coverage_pct FROM cl GROUP BY ALL""", "cl")


def _covered(spark, sf_dir) -> DataFrame:
    return D.checklist_coverage(results(spark, sf_dir).select(*KEYS, "text"), checklist(spark), KEYS)


@query("checklist_items", sql("SELECT * FROM cl", "cl"))
def checklist_items(spark, sf_dir):
    return _covered(spark, sf_dir).select(*KEYS, "item", "status", "found")


@query("checklist_coverage", sql("""SELECT *, CASE WHEN coverage_pct >= 80 AND done >= 1 THEN 'VALID' WHEN coverage_pct >= 60 THEN 'INCOMPLETE' ELSE 'INVALID' END AS status FROM cs""", "cs"))
def checklist_coverage(spark, sf_dir):
    return D.checklist_summary(_covered(spark, sf_dir), KEYS)


@query("checklist_minimum", sql("""SELECT ts_code, min(coverage_pct) AS minimum_pct, min(done) AS minimum_done, CASE WHEN min(coverage_pct) >= 80 AND min(done) >= 1 THEN 'PASS'
 WHEN min(coverage_pct) >= 60 THEN 'INCOMPLETE' ELSE 'FAIL' END AS status FROM cs GROUP BY ts_code""", "cs"))
def checklist_minimum(spark, sf_dir):
    return D.checklist_minimum(D.checklist_summary(_covered(spark, sf_dir), KEYS), ["ts_code"])


@query("evidence_reuse", sql("""SELECT ts_code, expert_id, count(*) AS covered, count(*) AS distinct_evidence, false AS reused FROM cl WHERE found GROUP BY ALL""", "cl"))
def evidence_reuse(spark, sf_dir):
    return D.evidence_reuse(_covered(spark, sf_dir), KEYS)


@query("evidence_problems", sql("""SELECT ts_code, expert_id, item, path, 'path_missing' AS problem FROM (SELECT *, CASE item WHEN '应收账款检查' THEN 'balance.accounts_receiv_yi'
  WHEN '商誉减值分析' THEN 'balance.goodwill_yi' ELSE 'quarterly.ocf_ttm_yi' END AS path FROM cl WHERE found) WHERE path = 'balance.goodwill_yi' AND ts_code LIKE '1%'
 UNION ALL SELECT ts_code, expert_id, item, CASE item WHEN '应收账款检查' THEN 'balance.accounts_receiv_yi' ELSE 'balance.goodwill_yi' END, 'outside_domain' FROM cl
 WHERE found AND expert_id = 'macro-cyclist' AND item <> '现金流核对 OCF'""", "cl"))
def evidence_problems(spark, sf_dir):
    """Snapshots of runs whose id starts with 1 lack goodwill."""
    covered = _covered(spark, sf_dir)
    known = ["balance.accounts_receiv_yi", "balance.goodwill_yi", "quarterly.ocf_ttm_yi"]
    paths = covered.select("ts_code").distinct().select("ts_code", F.explode(F.array(*[F.lit(k) for k in known])).alias("path"))
    paths = paths.filter(~((F.col("path") == "balance.goodwill_yi") & F.col("ts_code").startswith("1")))
    return D.evidence_problems(covered, paths, KEYS)


@query("narrative_rows", sql("SELECT run_id AS ts_code, expert_id, 1 + (score >= 20)::INT + (score >= 60)::INT AS rows FROM res", "res"))
def narrative_rows(spark, sf_dir):
    return L.table_row_counts(results(spark, sf_dir).select(*KEYS, "text"), KEYS, D.NARRATIVE)


@query("knowledge_pages", sql("SELECT run_id AS ts_code, expert_id, 2 + (score >= 60)::INT AS pages FROM res", "res"))
def knowledge_pages(spark, sf_dir):
    pages = spark.createDataFrame([("valuation.md",), ("moat",), ("cycle.md",)], "page string")
    return D.knowledge_rows(results(spark, sf_dir).select(*KEYS, "text"), pages, KEYS)


@query("merged_segments", sql("SELECT run_id AS ts_code, expert_id, len(string_split(text, chr(10))) - 1 + CASE WHEN nxt THEN 1 ELSE 0 END AS lines FROM "
 "(SELECT *, lead(expert_id) OVER (PARTITION BY run_id ORDER BY expert_id) IS NOT NULL AS nxt FROM rd)", "rd"))
def merged_segments(spark, sf_dir):
    """All results of a run in one text, taken apart again by role."""
    from ledgerlens.schema import EXPERTS

    merged = D.assemble(results(spark, sf_dir), ["ts_code"], ["expert_id"], text="text")
    rows = L.expert_segments(L.lines(merged, ["ts_code"]), ["ts_code"], EXPERTS)
    return rows.groupBy("ts_code", "expert_id").agg(F.count(F.lit(1)).alias("lines"))


_KNOWN = (("market.pe_ttm", 9.5), ("market.total_mv_yi", 100.0), ("market.close", 3.0), ("market.pb", 2.0), ("balance.cash_yi", 1.0),
          ("balance.accounts_receiv_yi", 1.0), ("balance.goodwill_yi", 1.0), ("quarterly.ocf_ttm_yi", 1.0))


@query("result_evidence", sql("""SELECT run_id AS ts_code, expert_id, 'R18' AS rule_id FROM res WHERE score < 60 UNION ALL SELECT run_id, expert_id, 'R19' FROM res WHERE score < 60
 UNION ALL SELECT run_id, expert_id, 'R21' FROM res WHERE score < 50 OR verdict = 'VETO' OR dir = 'NEUTRAL' UNION ALL SELECT run_id, expert_id, 'R22' FROM res
 UNION ALL SELECT run_id, expert_id, 'R23' FROM res WHERE score >= 50 AND industry = 'ASIA' UNION ALL SELECT run_id, expert_id, 'R24' FROM res""", "res"))
def result_evidence(spark, sf_dir):
    """The evidence rules over all results; snapshots of one industry lack the book multiple the formula needs."""
    r = results(spark, sf_dir)
    known = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(p).alias("path"), F.lit(v).alias("value")) for i, (p, v) in enumerate(_KNOWN)])
    cards_ = r.select("ts_code", "industry").distinct()
    facts = cards_.select("ts_code", "industry", F.inline(known)).filter("industry <> 'ASIA' or path <> 'market.pb'").drop("industry")
    facts = facts.withColumn("unit", V.infer_unit("path"))
    gaps = cards_.select("ts_code", *[F.lit(False).alias(n) for n, _ in K.CONTRADICTIONS])
    sections = spark.createDataFrame([], "ts_code string, report_year int, report_type string, section_name string, section_text string")
    pages = spark.createDataFrame([("valuation",), ("moat",), ("cycle",)], "page string")
    return C.audit(r.select(*KEYS, "text"), _snapshots(spark, sf_dir), facts, facts.select("ts_code", "path"), sections, checklist(spark), pages, gaps, C.EVIDENCE_RULES, result_tasks(spark, sf_dir))


# --- the whole contract: one fault for each score ----------------------------------------------

#: Rules that the fault of ``score % 30`` breaks; 0 and 1 are results without fault.
_FAULTS = {
    2: ("R2", "R18", "R19", "R21", "R22", "R24"), 3: ("R3", "R20", "R22", "R24"), 4: ("R4",), 5: ("R4", "R5"), 6: ("R4", "R6"), 18: ("R18", "R22"), 20: ("R20", "R22", "R24"),
    25: ("R24",), 26: ("R24",), 27: ("R22",), 28: ("R23",),
} | {i: (f"R{i}",) for i in (*range(7, 18), 19, 21, 22, 23, 24)}
_PAGES = ("valuation", "moat", "cycle")


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that keep the contract but for one fault, on facts that follow from the scores of their run."""
    r = runs.tables(spark, sf_dir)["expert_results"].withColumnRenamed("conclusion_direction", "dir")
    r = r.select(F.col("run_id").alias("ts_code"), "expert_id", "score", "dir", F.date_format("created_at", "yyyyMMdd").alias("day"), F.pmod("score", F.lit(30)).alias("v"))
    r = r.join(_run_facts(r).drop("day").hint("merge"), "ts_code")
    v = F.col("v")

    def line(*parts, when: Column | None = None) -> Column:
        whole = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
        return whole if when is None else F.when(when, whole)

    def stated(name: str, value: Column, wrong: int, instead: str) -> Column:
        return line(f"{name}: ", F.when(v == wrong, instead).otherwise(value), when=v != 6)
    fence = line("---", when=v != 6)
    money = lambda x: F.format_string("%.2f", F.col(x))
    said = ~v.isin(3, 20)
    rows = [line(f"| {i + 1} | “", F.when((v == 22) & F.lit(i == 2), F.reverse(_quote(i))).otherwise(_quote(i)), "”（年报:2000/annual/经营情况讨论与分析） | `annual.goodwill_yi` | 一致",
                 F.when(said, " [source: annual.goodwill_yi]").otherwise(""), " |", when=(v != 18) | F.lit(i < 2)) for i in range(3)]
    receivable = F.when(v == 27, "quarterly.receiv_nowhere").otherwise("quarterly.accounts_receiv_yi")
    receivable = F.when(v == 29, "forecast.receiv_yi").otherwise(receivable)
    text = F.concat_ws(
        "\n", line("说明", when=v == 4), line("```yaml", when=v == 5), fence, stated("expert_id", F.col("expert_id"), 7, "nobody"), stated("ts_code", F.col("ts_code"), 8, "none"),
        stated("score", F.col("score").cast("string"), 9, "n/a"), line("verdict: ", F.when(v == 10, "MAYBE").when(v == 11, "VETO").otherwise("PASS"), when=v != 6),
        line("veto_triggers: []", when=v != 6), stated("conclusion_direction", F.col("dir"), 13, "UP"), stated("data_date", F.col("day"), 14, "19990101"),
        stated("analysis_date", F.col("day"), 16, "19990101"), stated("batch_id", F.col("ts_code"), 15, "stale"), fence, line("```", when=v == 5), F.lit("## 总体判断"),
        line(F.repeat(F.lit("判断"), 600), when=v != 3), line("⛔ VETO 已触发", when=v.isin(11, 12)), F.lit("## 详细分析"),
        line("收盘价 ", money("close"), " [source: market.close]", when=said), line("PB ", money("pb"), " [source: market.pb]", when=said),
        line("营收 ", money("before"), "亿 [source: annual.annual_data[0].revenue_yi]", when=said), line("营收 ", money("now"), "亿 [source: annual.annual_data[1].revenue_yi]", when=said),
        line("营收同比 ", F.format_string("%.1f", (F.col("now") / F.col("before") - 1) * 100),
             "% [calc: (current/previous-1)*100; inputs: annual.annual_data[1].revenue_yi, annual.annual_data[0].revenue_yi]", when=said),
        line("营收创历史新高 [source: annual.annual_data[0].revenue_yi, annual.annual_data[1].revenue_yi]", when=said),
        line("行业平均 ROE ", money("roe"), "% [source: industry.industry_stats.roe_pct.median]", when=said),
        line("来源不明 [source: market.nowhere]", when=v == 23), line("账上现金 77.77亿", when=v == 24), line("公司零商誉，经营稳健", when=v == 25), line("据悉订单充足", when=v == 26),
        line("不可重算 [calc: a/; inputs: market.close]", when=v == 28), F.lit(D.NARRATIVE), F.lit("| # | 论述 | 字段 | 结论 |"), F.lit("|---|---|---|---|"), *rows,
        F.lit("## 关键风险与不确定性"), F.lit("## 必检项执行记录"), F.lit("| 必检项 | 状态 | 证据 | 结论 |"), F.lit("|---|---|---|---|"),
        line("| 应收账款检查 | ", F.when(v == 21, "MISSING").otherwise("DONE"), " | `", receivable, "` | 应收账款平稳可控 |"),
        F.lit("| 商誉减值分析 | DONE | `annual.goodwill_yi` | 商誉占比很低 |"), F.lit("| 现金流核对 OCF | DONE | `quarterly.ocf_ttm_yi` | OCF 与利润匹配 |"),
        line("## 数据使用说明", when=v != 17), F.lit(D.KNOWLEDGE_LOG), F.lit("| # | 页面 | 用途 |"), F.lit("|---|---|---|"),
        *[line(f"| {i + 1} | ", F.when((v == 19) & F.lit(i == 2), "absent").otherwise(p), " | 框架 |") for i, p in enumerate(_PAGES)])
    return r.select(*KEYS, F.when(v != 2, text).otherwise("").alias("text"))


def _run_facts(results: DataFrame) -> DataFrame:
    per = results.groupBy("ts_code").agg(F.max("score").alias("best"), F.min("score").alias("worst"), F.max("day").alias("day"))
    return per.select("ts_code", "day", (F.col("best") + 0.25).alias("close"), (F.col("worst") / 4 + 1).alias("pb"), (100.0 + F.col("worst")).alias("before"),
                      (120.0 + F.col("best")).alias("now"), (F.col("best") / 8 + 2).alias("roe"))


def _letters() -> Column:
    return F.translate(F.sha2("ts_code", 256), "0123456789", "ghijklmnop")


def _quote(i: int) -> Column:
    """Letters of the run's section from its start, middle or end."""
    return F.substring(_letters(), (1, 30, 51)[i], (14, 6, 14)[i])


def _contract_tables(spark: SparkSession, sf_dir: str) -> StagedTables:
    return StagedTables(spark, sf_dir, {"audited": lambda: _audited(spark, sf_dir)})


block("ca", " UNION ALL ".join(f"SELECT run_id AS ts_code, expert_id, '{rule}' AS rule_id FROM res WHERE score % 30 = {v}" for v, rules in _FAULTS.items() for rule in rules)
      + " UNION ALL SELECT run_id, expert_id, 'R22' FROM res WHERE score % 30 = 29 AND expert_id <> 'financial-auditor'", "res")


@query("contract_audit", sql("SELECT * FROM ca", "ca"))
def contract_audit(spark, sf_dir):
    """R2 to R24 over results that each break one rule or none, in one pass."""
    r = runs.tables(spark, sf_dir)["expert_results"].select(F.col("run_id").alias("ts_code"), "score", F.date_format("created_at", "yyyyMMdd").alias("day"))
    f = _run_facts(r)
    known = {"market.close": "close", "market.pb": "pb", "annual.annual_data[0].revenue_yi": "before", "annual.annual_data[1].revenue_yi": "now",
             "industry.industry_stats.roe_pct.median": "roe"}
    fixed = {"industry.industry_stats.roe_pct.count": 7.0, "annual.goodwill_yi": 1.0, "quarterly.ocf_ttm_yi": 2.0, "quarterly.accounts_receiv_yi": 3.0, "forecast.receiv_yi": 4.0}
    listed = F.array(*[F.struct(F.lit(p).alias("path"), F.col(c).cast("double").alias("value")) for p, c in known.items()],
                     *[F.struct(F.lit(p).alias("path"), F.lit(x).alias("value")) for p, x in fixed.items()])
    facts = f.select("ts_code", F.inline(listed)).withColumn("unit", V.infer_unit("path"))
    snapshots = f.select("ts_code", F.col("day").alias("data_date"), F.col("day").alias("analysis_date"), F.col("ts_code").alias("batch_id"))
    sections = f.select("ts_code", F.lit(2000).alias("report_year"), F.lit("annual").alias("report_type"), F.lit("第三节 经营情况讨论与分析").alias("section_name"),
                        F.regexp_replace(_letters(), "(.{7})", "$1，").alias("section_text"))
    gaps = f.select("ts_code", *[F.lit(n == "goodwill_unknown").alias(n) for n, _ in K.CONTRADICTIONS])
    pages = spark.createDataFrame([(p,) for p in _PAGES], "page string")
    docs = _contract_tables(spark, sf_dir)["audited"]
    return C.audit(docs, snapshots, facts, facts.select("ts_code", "path"), sections, checklist(spark), pages, gaps)


@query("invalid_formulas", sql("SELECT run_id AS ts_code, expert_id FROM res WHERE score >= 50 AND industry = 'ASIA'", "res"))
def invalid_formulas(spark, sf_dir):
    r = results(spark, sf_dir)
    pairs = [(p, v) for p, v in _KNOWN if p in ("market.close", "market.pb")]
    known = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(v).alias("value")) for p, v in pairs])
    facts = r.select("ts_code", "industry").distinct().select("ts_code", "industry", F.inline(known)).filter("industry <> 'ASIA' or path <> 'market.pb'")
    return K.invalid_formulas(r.select(*KEYS, "text"), facts, KEYS).select(*KEYS)


# --- reviews -------------------------------------------------------------------------------

_REVIEW_TEXT = """concat_ws(chr(10), '---', 'expert_id: ' || expert_id, 'ts_code: ' || run_id, 'data_date: ' || day, 'analysis_date: ' || day,
 'batch_id: ' || run_id, 'expert_result_hash: ' || CASE WHEN verdict = 'VETO' THEN 'changed' ELSE hash END,
 'challenge_verdict: ' || CASE WHEN dir = 'POSITIVE' THEN 'UPGRADED' WHEN dir = 'NEGATIVE' THEN 'DOWNGRADED' ELSE 'SAME' END, '---',
 '## 合并回应（150-300 个中文字符）', '', repeat('回', score * 4) || CASE WHEN score >= 90 THEN ' [source: market.close]' ELSE '' END)"""
block("rv", f"SELECT *, {_REVIEW_TEXT} AS review FROM (SELECT *, sha256(text) AS hash FROM rd)", "rd")


@query("review_audit", sql("""SELECT run_id AS ts_code, expert_id, 'expert_result_hash' AS problem FROM rv WHERE verdict = 'VETO'
 UNION ALL SELECT run_id, expert_id, 'challenge_verdict' FROM rv WHERE dir = 'NEUTRAL'
 UNION ALL SELECT run_id, expert_id, 'response_length' FROM rv WHERE score * 4 NOT BETWEEN 150 AND 300
 UNION ALL SELECT run_id, expert_id, 'response_cites' FROM rv WHERE score >= 90""", "rv"))
def review_audit(spark, sf_dir):
    r = runs.tables(spark, sf_dir)["expert_results"].withColumnsRenamed({"conclusion_direction": "dir"})
    r = r.withColumn("day", F.date_format("created_at", "yyyyMMdd")).withColumn("text", F.expr(_RESULT_TEXT)).withColumn("hash", F.sha2("text", 256))
    reviews = r.select(F.col("run_id").alias("ts_code"), "expert_id", F.expr(_REVIEW_TEXT).alias("text"))
    originals = r.select(F.col("run_id").alias("ts_code"), "expert_id", "text", F.col("day").alias("data_date"),
                         F.col("day").alias("analysis_date"), F.col("run_id").alias("batch_id"))
    return D.challenge_problems(reviews, originals)


_CROSS_TEXT = """concat_ws(chr(10), '---', 'reviewer_id: r1', 'ts_code: ' || run_id, 'data_date: ' || day, 'analysis_date: ' || day, 'batch_id: ' || run_id,
 'input_bundle_hash: ' || run_id, 'cross_verdict: ' || CASE WHEN best >= 99 THEN 'MAYBE' ELSE 'CONFIRM' END, '---', '## 遗漏与矛盾', repeat('述', best * 10),
 '## 反事实压力测试', CASE WHEN worst < 5 THEN '## 反事实压力测试' END, CASE WHEN roles = 7 THEN '## 对裁判长的影响' END)"""
block("xr", f"SELECT *, {_CROSS_TEXT} AS review FROM (SELECT run_id, day, max(score) AS best, min(score) AS worst, count(*) AS roles FROM rd GROUP BY ALL)", "rd")


@query("cross_review_audit", sql("""SELECT run_id AS ts_code, 'r1' AS reviewer_id, 'cross_verdict' AS problem FROM xr WHERE best >= 99
 UNION ALL SELECT run_id, 'r1', 'too_short' FROM xr WHERE length(trim(review)) < 1000 UNION ALL SELECT run_id, 'r1', 'heading ## 反事实压力测试' FROM xr WHERE worst < 5
 UNION ALL SELECT run_id, 'r1', 'heading ## 对裁判长的影响' FROM xr WHERE roles < 7""", "xr"))
def cross_review_audit(spark, sf_dir):
    r = runs.tables(spark, sf_dir)["expert_results"].withColumn("day", F.date_format("created_at", "yyyyMMdd"))
    per = r.groupBy("run_id", "day").agg(F.max("score").alias("best"), F.min("score").alias("worst"), F.count(F.lit(1)).alias("roles"))
    reviews = per.select(F.col("run_id").alias("ts_code"), F.lit("r1").alias("reviewer_id"), F.expr(_CROSS_TEXT).alias("text"))
    snaps = per.select(F.col("run_id").alias("ts_code"), F.col("day").alias("data_date"), F.col("day").alias("analysis_date"),
                       F.col("run_id").alias("batch_id"), F.col("run_id").alias("input_bundle_hash"))
    return D.cross_review_problems(reviews, snaps)


# --- company reports -----------------------------------------------------------------------


def company_reports(docs: DataFrame) -> DataFrame:
    last = F.try_element_at("annual.annual_data", F.lit(-1))
    prev = F.try_element_at("annual.annual_data", F.lit(-2))
    n = F.size("annual.annual_data")
    growth = (last["revenue_yi"] / prev["revenue_yi"] - 1) * 100
    path = lambda i: F.concat(F.lit("annual.annual_data["), (n - i).cast("string"), F.lit("].revenue_yi"))
    roe = F.try_element_at("industry.industry_stats", F.lit("roe_pct"))
    line = lambda *parts: F.coalesce(F.concat(*parts), F.lit(""))

    def shown(pattern: str, x: Column) -> Column:
        return F.when(x.isNotNull(), F.format_string(pattern, x))

    text = F.concat_ws(
        "\n",
        F.lit("# 公司报告"),
        line(F.lit("收盘价 "), shown("%.2f", F.col("market.close")), F.lit(" [source: market.close]")),
        line(F.lit("总市值 "), shown("%.2f", F.col("market.total_mv_yi")), F.lit("亿 [source: "),
             F.when(F.col("market.pe_ttm") < 0, "market.close").otherwise("market.total_mv_yi"), F.lit("]")),
        line(F.lit("营收同比 "), shown("%.1f", growth), F.lit("% [calc: (current/previous-1)*100; inputs: "), path(1), F.lit(", "), path(2), F.lit("]")),
        line(F.lit("账上现金 "), shown("%.2f", F.col("balance.cash_yi")), F.lit("亿")),
        line(F.lit("行业平均 ROE "), shown("%.2f", roe["median"]), F.lit("% [source: industry.industry_stats.roe_pct.median]")),
        F.lit("公司零商誉，经营稳健"),
        F.lit("营收创历史新高 [source: annual.annual_data[0].revenue_yi]"),
    )
    return docs.select("ts_code", text.alias("text"))


def _report_tables(spark, sf_dir) -> StagedTables:
    """The reports, checked against the facts of all sections of the company documents."""
    staged = {
        "card_facts": lambda: snapshot.facts(fundamentals.sections(spark, sf_dir), sections=list(snapshot.SECTIONS)),
        "company_reports": lambda: company_reports(fundamentals.sections(spark, sf_dir)),
        "traced": lambda: K.trace(K.claims(tables["company_reports"], ["ts_code"]), tables["card_facts"], ["ts_code"]),
    }
    tables = StagedTables(spark, sf_dir, staged)
    return tables


block("card", """SELECT s.ts_code, m.close, m.pe_ttm, round(m.total_mv / 1e4, 2) AS mv, a.n, a.rev, a.prev, round(b.money_cap / 1e8, 2) AS cash, b.goodwill,
 p.median AS roe, p.n AS peers FROM stocks s LEFT JOIN mkt m USING (ts_code)
 LEFT JOIN (SELECT ts_code, count(*) AS n, arg_max(round(total_revenue / 1e8, 2), y) AS rev, max(round(prev / 1e8, 2)) FILTER (pos = 1) AS prev FROM
  (SELECT *, lag(total_revenue) OVER (PARTITION BY ts_code ORDER BY y) AS prev, row_number() OVER (PARTITION BY ts_code ORDER BY y DESC) AS pos FROM annual) GROUP BY 1) a USING (ts_code)
 LEFT JOIN (SELECT * FROM bal3 WHERE pos = 1) b USING (ts_code) LEFT JOIN (SELECT * FROM cmp WHERE metric = 'roe_pct' AND n > 0) p USING (ts_code)""",
 "stocks", "mkt", "annual", "bal3", "cmp")
block("said", """SELECT ts_code, 2 AS line, close AS x, 2 AS d, '' AS unit, 'DIRECT' AS trace_status FROM card WHERE close IS NOT NULL
 UNION ALL SELECT ts_code, 3, mv, 2, '亿', CASE WHEN pe_ttm < 0 THEN 'UNTRACED' ELSE 'DIRECT' END FROM card WHERE mv IS NOT NULL
 UNION ALL SELECT ts_code, 4, (rev / prev - 1) * 100, 1, '%', 'DERIVED' FROM card WHERE prev IS NOT NULL
 UNION ALL SELECT ts_code, 5, cash, 2, '亿', 'UNTRACED' FROM card WHERE cash IS NOT NULL
 UNION ALL SELECT ts_code, 6, roe, 2, '%', CASE WHEN peers >= 5 THEN 'DIRECT' ELSE 'UNTRACED' END FROM card WHERE roe IS NOT NULL""", "card")


@query("claims", sql("SELECT ts_code, line, CASE d WHEN 1 THEN round(x, 1) ELSE round(x, 2) END AS value, unit, 'data' AS category FROM said", "said"))
def claims(spark, sf_dir):
    found = K.claims(_report_tables(spark, sf_dir)["company_reports"], ["ts_code"])
    return found.select("ts_code", "line", (F.col("value") + 0.0).alias("value"), "unit", "category")


@query("claim_trace", sql("""SELECT ts_code, line, trace_status, CASE trace_status WHEN 'DIRECT' THEN 1 WHEN 'DERIVED' THEN 2 ELSE 0 END AS paths FROM said""", "said"))
def claim_trace(spark, sf_dir):
    return _report_tables(spark, sf_dir)["traced"].select("ts_code", "line", "trace_status", F.size("traced_paths").alias("paths"))


@query("claim_candidates")
def claim_candidates(spark, sf_dir):
    t = _report_tables(spark, sf_dir)
    return K.value_only_candidates(t["traced"], t["card_facts"], ["ts_code"])


@query("report_coverage", sql("""SELECT ts_code, count(*) AS data_numbers, count(*) FILTER (trace_status <> 'UNTRACED') AS traced,
 count(*) FILTER (trace_status = 'UNTRACED') AS untraced, round(100.0::DOUBLE * count(*) FILTER (trace_status <> 'UNTRACED') / count(*), 1) AS trace_pct FROM said GROUP BY 1""", "said"))
def report_coverage(spark, sf_dir):
    return K.coverage(_report_tables(spark, sf_dir)["traced"], ["ts_code"])


@query("evidence_breadth", sql("""SELECT ts_code, count(*) AS data_numbers, count(*) FILTER (trace_status <> 'UNTRACED') AS traced,
 sum(CASE trace_status WHEN 'DIRECT' THEN 1 WHEN 'DERIVED' THEN 2 ELSE 0 END)::BIGINT AS paths,
 count(*) >= 5 AND count(*) FILTER (trace_status <> 'UNTRACED') >= 5 AND sum(CASE trace_status WHEN 'DIRECT' THEN 1 WHEN 'DERIVED' THEN 2 ELSE 0 END) >= 3 AS enough
 FROM said GROUP BY 1""", "said"))
def evidence_breadth(spark, sf_dir):
    return K.evidence_breadth(_report_tables(spark, sf_dir)["traced"], ["ts_code"])


block("loose", """SELECT ts_code, 6 AS line, 'industry' AS label FROM card WHERE roe IS NOT NULL AND peers < 5
 UNION ALL SELECT ts_code, 8, 'history' FROM card""", "card")


@query("unsupported_assertions", sql("SELECT * FROM loose", "loose"))
def unsupported_assertions(spark, sf_dir):
    t = _report_tables(spark, sf_dir)
    return K.unsupported_assertions(t["company_reports"], t["card_facts"], ["ts_code"]).select("ts_code", "line", "label")


def _gaps(cards_: DataFrame) -> DataFrame:
    missing = lambda c: F.col(c).isNull()
    return cards_.select("ts_code", missing("balance.goodwill_yi").alias("goodwill_unknown"), missing("balance.interest_debt_yi").alias("debt_unknown"),
                         F.lit(True).alias("fcf_incomplete"), F.lit(True).alias("macro_missing"), F.lit(True).alias("not_cross_validated"))


@query("contradictions", sql("SELECT ts_code, 7 AS line, 'goodwill_unknown' AS label FROM card WHERE goodwill IS NULL", "card"))
def contradictions(spark, sf_dir):
    t = _report_tables(spark, sf_dir)
    return K.contradictions(t["company_reports"], _gaps(fundamentals.sections(spark, sf_dir)), ["ts_code"]).select("ts_code", "line", "label")


@query("report_verdicts", sql("""SELECT s.ts_code, trace_pct, untraced, coalesce(u.n, 0) AS unsourced, CASE WHEN trace_pct >= 75 AND pct >= 60 THEN 'FLAGGED' ELSE 'FAIL' END AS verdict
 FROM (SELECT ts_code, count(*) FILTER (trace_status = 'UNTRACED') AS untraced, round(100.0::DOUBLE * count(*) FILTER (trace_status <> 'UNTRACED') / count(*), 1) AS trace_pct FROM said GROUP BY 1) s
 LEFT JOIN (SELECT ts_code, count(*) AS n FROM (SELECT ts_code FROM loose UNION ALL SELECT ts_code FROM card WHERE goodwill IS NULL) GROUP BY 1) u ON u.ts_code = s.ts_code
 JOIN (SELECT ts_code, CASE WHEN pe_ttm > 0 THEN 70.0 ELSE 50.0 END AS pct FROM card) c ON c.ts_code = s.ts_code""", "said", "loose", "card"))
def report_verdicts(spark, sf_dir):
    t = _report_tables(spark, sf_dir)
    issues = K.unsupported_assertions(t["company_reports"], t["card_facts"], ["ts_code"]).select("ts_code").unionByName(
        K.contradictions(t["company_reports"], _gaps(fundamentals.sections(spark, sf_dir)), ["ts_code"]).select("ts_code"))
    per = issues.groupBy("ts_code").agg(F.count(F.lit(1)).alias("unsourced"))
    stats = K.coverage(t["traced"], ["ts_code"]).join(per, "ts_code", "left").fillna(0, ["unsourced"]).join(
        fundamentals.sections(spark, sf_dir).select("ts_code", F.when(F.col("market.pe_ttm") > 0, 70.0).otherwise(50.0).alias("checklist_pct")), "ts_code")
    stats = stats.withColumns({"date_issues": F.lit(0), "identity_issues": F.lit(0), "checklist_done": F.lit(1)})
    return K.report_verdicts(stats).select("ts_code", "trace_pct", "untraced", "unsourced", "verdict")


@query("first_traceable", sql("""SELECT ts_code, 'market.close' AS path FROM card WHERE close IS NOT NULL""", "card"))
def first_traceable(spark, sf_dir):
    found = K.claims(_report_tables(spark, sf_dir)["company_reports"], ["ts_code"])
    return K.first_traceable(found, ["ts_code"]).select("ts_code", "path")


@query("document_numbers")
def document_numbers(spark, sf_dir):
    """Numbers in all documents, whole texts."""
    d = proxy.raw(spark, sf_dir, "documents").select("doc_id", "text")
    return K.claims(d, ["doc_id"]).select("doc_id", "line", "pos", "value", "unit", "category")


# --- sections ------------------------------------------------------------------------------

_YEARBOOK = [
    "name || CASE WHEN ann THEN '年度报告' ELSE '半年度报告' END",
    "CASE WHEN rated THEN '第一节 重要提示' END",
    "'内容 ' || CAST(rev AS STRING)",
    "CASE WHEN rated THEN '第二节 公司治理' END",
    "'治理 ' || CAST(prof AS STRING)",
    "CASE WHEN rated THEN '第三节 财务报告' END",
    "'报表 ' || CAST(assets AS STRING)",
]
_YEARBOOK_TEXT = f"concat_ws(chr(10), {', '.join(_YEARBOOK)})"
block("book", f"SELECT yb.ts_code, y, rev, prof, assets, ann, rated, {_YEARBOOK_TEXT} AS text FROM yb JOIN stocks USING (ts_code)", "yb", "stocks")


def yearbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = proxy.year_base(spark, sf_dir).withColumns({"ann": F.col("ann") == 1, "rated": F.col("rated") == 1})
    s = proxy.tables(spark, sf_dir)["stocks"].select("ts_code", "name")
    return y.join(s, "ts_code").select("ts_code", "y", F.expr(_YEARBOOK_TEXT).alias("text"))


@query("report_sections", sql("""SELECT ts_code, y, CASE WHEN ann THEN 'annual' ELSE 'semi_annual' END AS kind, u.s.section_name AS section_name, length(u.s.body) AS chars FROM book,
 LATERAL (SELECT unnest(CASE WHEN rated THEN [{'section_name': '前言及目录', 'body': split_part(text, chr(10), 1)}, {'section_name': '第一节 重要提示', 'body': '内容 ' || rev},
  {'section_name': '第二节 公司治理', 'body': '治理 ' || prof}, {'section_name': '第三节 财务报告', 'body': '报表 ' || assets}] ELSE [{'section_name': '全文', 'body': text}] END) AS s) u""", "book"))
def report_sections(spark, sf_dir):
    books = yearbooks(spark, sf_dir)
    kinds = books.select("ts_code", "y", L.report_kind(F.col("text")).alias("kind"))
    parts = L.split_by_heading(books, ["ts_code", "y"])
    return kinds.join(parts, ["ts_code", "y"]).select("ts_code", "y", "kind", "section_name", F.length("section_text").alias("chars"))


@query("named_sections", sql("""SELECT ts_code, y, u.s.section_name AS section_name, length(u.s.body) AS chars FROM book,
 LATERAL (SELECT unnest(CASE WHEN rated THEN [{'section_name': '重要提示、目录和释义', 'body': '第一节 重要提示' || chr(10) || '内容 ' || rev},
  {'section_name': '公司治理', 'body': '第二节 公司治理' || chr(10) || '治理 ' || prof}, {'section_name': '财务报告', 'body': '第三节 财务报告' || chr(10) || '报表 ' || assets}]
  ELSE [{'section_name': '全文', 'body': text}] END) AS s) u""", "book"))
def named_sections(spark, sf_dir):
    parts = L.split_by_names(yearbooks(spark, sf_dir), ["ts_code", "y"])
    return parts.select("ts_code", "y", "section_name", F.length("section_text").alias("chars"))


@query("line_sections", """SELECT doc_id, count(*) AS lines, sum(length(l)) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id""")
def line_sections(spark, sf_dir):
    d = proxy.raw(spark, sf_dir, "documents").select("doc_id", "text")
    return L.lines(d, ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("raw_line")).alias("chars"))


@query("document_assembly", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def document_assembly(spark, sf_dir):
    """Documents taken apart into lines and put together again, in order."""
    d = proxy.raw(spark, sf_dir, "documents").select("doc_id", "text")
    whole = D.assemble(L.lines(d, ["doc_id"]), ["doc_id"], ["line"], text="raw_line")
    return whole.select("doc_id", F.sha2("text", 256).alias("sha256"))


def _fiscal():
    return F.lit(2000)


block("long_enough", "SELECT * FROM reports WHERE length(trim(section_text)) >= 200", "reports")
block("usable", """SELECT * FROM long_enough WHERE (ts_code, report_year) IN (SELECT (ts_code, report_year) FROM long_enough GROUP BY ts_code, report_year HAVING sum(length(section_text)) >= 1000)""", "long_enough")
block("readable", """SELECT * FROM long_enough WHERE report_year BETWEEN 1996 AND 2000 AND (ann_date IS NULL OR ann_date <= DATE '2000-06-15')""", "long_enough")


def _readable(spark, sf_dir, historical: bool = False) -> DataFrame:
    return D.readable_sections(ingest.reports(spark, sf_dir), F.lit("2000-06-15").cast("date"), _fiscal(), historical=historical)


@query("usable_sections", sql("SELECT ts_code, report_year, section_name FROM usable", "usable"))
def usable_sections(spark, sf_dir):
    from ledgerlens.sources import ingest as G

    return G.usable_sections(ingest.reports(spark, sf_dir)).select("ts_code", "report_year", "section_name")


@query("readable_sections", sql("""SELECT ts_code, report_year, section_name, ann_date IS NULL AS undated FROM readable""", "readable"))
def readable_sections(spark, sf_dir):
    return _readable(spark, sf_dir).select("ts_code", "report_year", "section_name", F.col("ann_date").isNull().alias("undated"))


@query("historical_sections", sql("SELECT ts_code, report_year, section_name FROM readable WHERE ann_date IS NOT NULL", "readable"))
def historical_sections(spark, sf_dir):
    return _readable(spark, sf_dir, historical=True).select("ts_code", "report_year", "section_name")


WANTED = {"financial-auditor": ("7", "3"), "moat-analyst": ("1",)}
block("budgeted", """SELECT *, sum(least(length(section_text), 1200)) OVER (PARTITION BY ts_code, expert_id ORDER BY report_year DESC, report_type, section_name ROWS UNBOUNDED PRECEDING)::BIGINT AS total_chars
 FROM (SELECT r.*, 'financial-auditor' AS expert_id FROM readable r WHERE section_name LIKE '%7%' OR section_name LIKE '%3%'
 UNION ALL SELECT r.*, 'moat-analyst' FROM readable r WHERE section_name LIKE '%1%')""", "readable")


@query("text_budget", sql("SELECT ts_code, expert_id, section_name, length(section_text) > 1200 AS cut, total_chars FROM budgeted WHERE total_chars <= 12000", "budgeted"))
def text_budget(spark, sf_dir):
    rows = D.relevant_sections(_readable(spark, sf_dir), WANTED)
    order = [F.col("report_year").desc(), F.col("report_type"), F.col("section_name")]
    kept = D.within_budget(rows, ["ts_code", "expert_id"], order, budget=12_000, cap=1_200)
    return kept.filter("kept").select("ts_code", "expert_id", "section_name", "cut", "total_chars")


@query("latest_report", sql("""SELECT ts_code, report_year, report_type FROM readable QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY report_year DESC,
 CASE report_type WHEN 'annual' THEN 0 WHEN 'semi-annual' THEN 1 WHEN 'q3' THEN 2 WHEN 'q1' THEN 3 ELSE 99 END) = 1""", "readable"))
def latest_report(spark, sf_dir):
    return D.latest_report(_readable(spark, sf_dir)).select("ts_code", "report_year", "report_type")


@query("text_coverage", sql("SELECT ts_code, report_year, report_type, count(*) AS sections, sum(length(section_text))::BIGINT AS chars FROM reports GROUP BY ALL", "reports"))
def text_coverage(spark, sf_dir):
    return D.text_coverage(ingest.reports(spark, sf_dir))


@query("section_names", sql("""SELECT ts_code, report_year, report_type, section_name, sum(length(section_text))::BIGINT AS chars
 FROM reports GROUP BY ALL""", "reports"))
def section_names(spark, sf_dir):
    return D.section_names(ingest.reports(spark, sf_dir))


@query("page_links", """SELECT DISTINCT page_id, trim(split_part(ref, '|', 1)) AS page FROM
 (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS ref FROM pages) WHERE trim(split_part(ref, '|', 1)) <> ''""")
def page_links(spark, sf_dir):
    p = proxy.raw(spark, sf_dir, "pages").select("page_id", "html")
    return L.page_links(p, ["page_id"], text="html", pattern='href="/([^"]+)"')


# --- quotes --------------------------------------------------------------------------------

block("qd", """SELECT d.doc_id, d.text, substr(regexp_replace(d.text, '[^a-zA-Z]', '', 'g'), 1, 12) AS chunk, coalesce(l.toxic, 0) AS toxic, coalesce(l.quality, 1) AS quality
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")


@query("quote_check", sql("""SELECT doc_id::VARCHAR AS ts_code, CASE WHEN length(chunk) >= 6 AND toxic = 0 AND quality = 1 THEN 1 ELSE 0 END AS verified FROM qd""", "qd"))
def quote_check(spark, sf_dir):
    """Reports that quote letters of their document three times over, by its id from the start, the middle or the end; toxic
    ones misquote, poor ones cite no real path."""
    t = StagedTables(spark, sf_dir, {"quoting": lambda: _write_quoting(spark, sf_dir)})
    d = t["quoting"]
    sections = d.select("ts_code", F.lit(2000).alias("report_year"), F.lit("annual").alias("report_type"),
                        F.lit("第三节 经营情况讨论与分析").alias("section_name"), "section_text")
    paths = d.filter("quality = 1").select("ts_code", F.lit("market.close").alias("path"))
    return D.verified_quotes(d.select("ts_code", "text"), sections, paths, ["ts_code"])


def _write_quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = proxy.raw(spark, sf_dir, "documents").join(proxy.raw(spark, sf_dir, "labels"), "doc_id", "left")
    letters = F.regexp_replace("text", "[^a-zA-Z]", "")
    place, last = F.pmod("doc_id", F.lit(3)), F.greatest(F.lit(1), F.length(letters) - 11)
    first = F.when(place == 1, ((last + 1) / 2).cast("int")).when(place == 2, last).otherwise(1)
    d = d.select(F.col("doc_id").cast("string").alias("ts_code"), letters.alias("body"), F.substring(letters, first, F.lit(12)).alias("chunk"),
                 F.coalesce("toxic", F.lit(0)).alias("toxic"), F.coalesce("quality", F.lit(1)).alias("quality"))
    quote = F.concat(F.col("chunk"), F.when(F.col("toxic") == 1, "ZZQQ").otherwise(""))
    row = lambda i: F.concat(F.lit(f"| {i} | “"), quote, F.lit("”（年报:2000/annual/经营情况讨论与分析） | `market.close` | 1 [source: market.close] |"))
    text = F.concat_ws("\n", F.lit(D.NARRATIVE), F.lit(""), row(1), row(2), row(3), F.lit("## 其他"))
    return d.select("ts_code", "quality", F.concat(F.lit("，"), F.col("body")).alias("section_text"), text.alias("text"))


@query("report_identifiers", sql("SELECT run_id AS ts_code, expert_id, CASE WHEN regexp_matches(ts, '^[0-9]{6}\\.') THEN ts END AS code, 'a/' || run_id AS manifest_path FROM "
 "(SELECT *, ts_code AS ts FROM res)", "res"))
def report_identifiers(spark, sf_dir):
    r = runs.tables(spark, sf_dir)["expert_results"]
    text = F.concat(F.lit("# 报告（"), "ts_code", F.lit("）\n<!-- artifact_manifest: a/"), "run_id", F.lit(" -->\nbatch_id: \"abcdef0123456789\"\n"))
    docs = r.select("run_id", "expert_id", text.alias("text"))
    code_, _, manifest = L.identifiers(F.col("text"))
    return docs.select(F.col("run_id").alias("ts_code"), "expert_id", code_.alias("code"), manifest.alias("manifest_path"))


@query("numbered_items", sql("SELECT run_id AS ts_code, expert_id, 1 + (score >= 50)::INT AS items FROM res", "res"))
def numbered_items(spark, sf_dir):
    r = runs.tables(spark, sf_dir)["expert_results"]
    text = F.concat_ws("\n", F.lit("## 魔鬼代言人问题库"), F.lit("1. **利润** 从何而来"), F.when(F.col("score") >= 50, "2. 现金去了哪里"), F.lit("## 其他"), F.lit("3. 无关"))
    docs = r.select(F.col("run_id").alias("ts_code"), "expert_id", text.alias("text"))
    return L.numbered_items(docs, KEYS, "## 魔鬼代言人问题库").groupBy(*KEYS).agg(F.count(F.lit(1)).cast("int").alias("items"))


@query("cjk_counts", sql("SELECT run_id AS ts_code, expert_id, score * 12 + 6 AS characters FROM res", "res"))
def cjk_counts(spark, sf_dir):
    r = runs.tables(spark, sf_dir)["expert_results"]
    text = F.concat(F.lit("总体判断 abc 12，"), F.expr("repeat('判断', score * 6)"), F.lit("。结论"))
    return r.select(F.col("run_id").alias("ts_code"), "expert_id", V.cjk_count(text).alias("characters"))
