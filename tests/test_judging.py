"""Documents judged line by line: each text is read once, with the meaning that the rules one by one give it."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.bindings import texts
from ledgerlens.operators import claims as K
from ledgerlens.operators import contract as C
from ledgerlens.operators import documents as D
from ledgerlens.operators import judging as J
from ledgerlens.operators import lines as L
from ledgerlens.operators import quotes as Q

SF = "/root/testdata/sf0.001"
PIECES = [
    "\n", "\r\n", "\r", "\x0b", "\x1c", "\x85", " ", "\n\n", "## 详细分析\n", "### 现金流 ##\n", "##x\n", "## 知识检索日志\n", D.NARRATIVE + "\n", "```yaml\n", "```\n", "| # | 评分 | 数 |\n",
    "|---|:-:|---|\n", "| 1 | 12.5 | 300 |\n", "| 2 | `7.5` | x |\n", "|", "营收 12.50亿 [source: annual.revenue_yi]\n", "PE 9.5 [source: JSON.market.pe, `market.pb`]", "市值 100 万元 [assumption: 管理层口头确认数据]\n",
    "同比 25.0% [calc: (a/b-1)*100; inputs: annual.x[1].revenue_yi, annual.x[0].revenue_yi]\n", "score: 55\n", "评分 88 分\n", "1. 其他 3 项\n", "１２个 2024 年 7 月\n", "　", " ", "毛利率 30~40%", "。", "股价 -3.5元",
]
FACTS = [("annual.revenue_yi", 12.5, "亿"), ("market.pe", 9.5, ""), ("market.pb", 9.5, None), ("annual.x[0].revenue_yi", 100.0, "亿"), ("annual.x[1].revenue_yi", 125.0, "亿")]


def documents(spark, n: int = 400):
    rng = random.Random(11)
    rows = [(f"C{i}", "moat-analyst", "".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 30)))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "ts_code string, expert_id string, text string")


def test_lines_and_regions_as_in_columns(spark):
    rows, docs = documents(spark)
    got = docs.select(F.split("text", r"\R").alias("lines"), L.region(F.col("text"), D.NARRATIVE).alias("rows"), L.region(F.col("text"), D.KNOWLEDGE_LOG).alias("log")).collect()
    for (_, _, text), r in zip(rows, got, strict=True):
        assert (J.split_lines(text), J.region(text, D.NARRATIVE), J.region(text, D.KNOWLEDGE_LOG)) == (r.lines, r.rows, r.log)


def test_numbers_in_context_as_in_columns(spark):
    """Data numbers and traced ones of every line, with its section, block and table header, as claims and trace find them."""
    rows, docs = documents(spark)
    facts = docs.select("ts_code", F.inline(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(v).alias("value"), F.lit(u).cast("string").alias("unit")) for p, v, u in FACTS])))
    traced = K.trace(K.claims(docs, list(C.KEYS)), facts, list(C.KEYS)).where("category = 'data'")
    per = traced.groupBy("ts_code", "line").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("trace_status") != "UNTRACED").alias("t")).collect()
    known = J.Known(FACTS, ())
    got = {(code, line): (n, t) for code, _, text in rows for line, n, t, _ in J.numbers(J.split_lines(text), known, K.recompute)}
    assert got == {(r.ts_code, r.line): (r.n, r.t) for r in per} and len(got) > 300


def test_texts_are_read_once(spark):
    """No window over lines and one Python step: a text is not taken apart again for each rule."""
    plan = texts.contract_audit(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and len(re.findall(r"MapInArrow|ArrowEvalPython", plan)) == 1


def test_lines_about_the_result_are_not_scanned(monkeypatch):
    seen = []
    monkeypatch.setattr(J, "scan_line", lambda s: seen.append(s) or K.scan_line(s))
    text = "score: 55\n## 2024 年\n营收 12.50亿 [source: annual.revenue_yi]\n## 知识检索日志\n| 1 | 12.5 |\n现金 3 [source: market.pe]\n```yaml\na: 1\n```\n评分 9\n没有"
    assert J.numbers(text.split("\n"), J.Known(FACTS, ()), K.recompute) == [(3, 1, 1, 1), (6, 1, 0, 0)]
    assert seen == ["营收 12.50亿 [source: annual.revenue_yi]", "现金 3 [source: market.pe]"]


def test_only_lines_with_a_locator_are_taken_apart(spark):
    docs = spark.createDataFrame([("A", "m", f"{D.NARRATIVE}\n| 1 | “长期投入研发” | x | 年报:2024/annual/讨论 |\n| 2 | “长期投入研发” | x | 无 |")], "ts_code string, expert_id string, text string")
    quotes = Q.quote_rows(docs, C.KEYS)
    assert [tuple(r) for r in quotes.collect()] == [("A", "m", 1, ["长期投入研发"], "2024", "annual", "讨论")]
    assert "Contains" in quotes._jdf.queryExecution().optimizedPlan().toString() or "年报:)" in quotes._jdf.queryExecution().optimizedPlan().toString()


def test_facts_of_a_path_and_their_peers():
    stat = "industry.industry_stats.roe.median"
    known = J.Known([(stat, 1.0, "%"), (stat, 2.0, "%"), ("industry.industry_stats.roe.count", float("nan"), ""), ("industry.target.pe_rank_pct", 3.0, "%"),
                     ("industry.industry_stats.pe.count", 4.0, ""), (None, 1.0, ""), ("a.b[0].c", None, "亿"), ("a.b[2].c", 1.0, "亿")], ["a.d", None])
    assert known.facts[stat] == (2.0, "%", True) and not known.sound("industry.target.pe_rank_pct") and not known.sound("a.b[0].c")
    assert known.points == {"a.b[*].c": 2} and known.exists("a.d") and known.exists("a.b[0].c") and not known.exists("a.b[*].c")


@pytest.mark.parametrize("size", [1, 3, 700])
def test_batches_of_any_size(size):
    """A company's facts come with each of its documents and are put in order once, wherever batches end."""
    item = '[{"item":"护城河","terms":["护城"],"token_groups":[["annual"]]}]'
    text = "营收 12.50亿 [source: annual.revenue_yi]\n| 护城河 | DONE | `annual.revenue_yi` | 护城河稳固持久 |\n## 知识检索日志\n| 1 | `a` |\n| 2 | wiki:b.md |"
    facts = [{"path": p, "value": v, "unit": u} for p, v, u in FACTS]
    rows = [{"ts_code": f"C{i // 2}", "expert_id": "moat-analyst", "text": text, "mask": 1, "expected": item if i % 3 else None, "gaps": None,
             "facts": facts if i < 600 else None, "bare": [], "held": []} for i in range(602)]
    schema = pa.schema([("ts_code", pa.string()), ("expert_id", pa.string()), ("text", pa.string()), ("mask", pa.int64()), ("expected", pa.string()), ("gaps", pa.list_(pa.bool_())),
                        ("facts", pa.list_(pa.struct([("path", pa.string()), ("value", pa.float64()), ("unit", pa.string())]))), ("bare", pa.list_(pa.string())),
                        ("held", pa.list_(pa.struct([("expert_id", pa.string()), ("row", pa.int32())])))])
    found = pa.Table.from_batches(J.judged(iter(pa.Table.from_pylist(rows, schema).to_batches(size)))).to_pylist()
    first = [r for r in found if r["line"] == 1]
    assert len(first) == 602 and [r["page"] for r in found if r["page"]] == ["a", "b"] * 602
    assert [r["traced"] for r in first] == [1] * 600 + [0] * 2 and {r["data"] for r in first} == {1}
    broken = [r["mask"] & ~1 for r in first]
    assert set(broken[:600]) == {J.R18 | J.R22} and set(broken[600:]) == {J.R18 | J.R22 | J.R23}


def test_evidence_rules_alone(spark):
    """Without rules on form the others say the same, and no front matter is read."""
    from test_contract import inputs

    docs, cards, facts, sections, checklist, pages, gaps = inputs(spark)
    rest = (cards, facts, facts.select("ts_code", "path"), sections, checklist, pages, gaps)
    every = {tuple(r) for r in C.audit(docs, *rest).collect()}
    some = C.audit(docs, *rest, C.EVIDENCE_RULES)
    assert {tuple(r) for r in some.collect()} == {r for r in every if r[2] in C.EVIDENCE_RULES} < every
    assert "conclusion_direction" not in some._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_dealt_results_are_not_exchanged(spark, monkeypatch):
    """Results lie by run where their texts are made; only what is known of their runs comes to them."""
    monkeypatch.setattr(texts, "RESULTS_A_TASK", 20)
    plan = texts.result_evidence(spark, SF)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    judge = next(i for i, x in enumerate(plan) if "MapInArrow" in x)
    made = next(i for i, x in enumerate(plan) if i > judge and "concat_ws" in x)
    above, at = [], depth(plan[made])
    for x in reversed(plan[judge + 1 : made]):
        if depth(x) < at:
            above.append(x)
            at = depth(x)
    assert any("Join" in x for x in above) and not any("Exchange" in x for x in above)
