"""The one-pass audit against the rules one by one, and quotes against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import claims as K
from ledgerlens.operators import contract as C
from ledgerlens.operators import documents as D
from ledgerlens.operators import quotes as Q

SECTIONS = "ts_code string, report_year int, report_type string, section_name string, section_text string"
MATTER = '---\nexpert_id: "{e}"\nts_code: {c}\nscore: {s}\nverdict: {v}\nveto_triggers: []\nconclusion_direction: POSITIVE\ndata_date: 20250102\nanalysis_date: 20250102\nbatch_id: b\n---\n'
BODIES = [
    "## 详细分析\n收盘价 9.50 [source: market.close]\nPB 2 [source: market.pb]\n营收同比 25.0% [calc: (a/b-1)*100; inputs: annual.annual_data[1].revenue_yi, annual.annual_data[0].revenue_yi]\n",
    "营收创历史新高 [source: annual.annual_data[0].revenue_yi]\n营收创历史新高 [source: annual.annual_data[0].revenue_yi, annual.annual_data[1].revenue_yi]\n",
    "行业平均 ROE 9.00% [source: industry.industry_stats.roe_pct.median]\n行业平均 PE [source: industry.industry_stats.pe.mean]\n公司零商誉，经营稳健；并非无商誉\n",
    "## 叙事–数据交叉验证\n| 1 | “长期投入研发项目” | market.close | 一致（年报:2024/annual/讨论） [source: market.close] |\n| 2 | “长期，投入研发…项目持续推进中” | market.pb | 年报:2024/annual/讨论 [source: market.pb] |\n| 3 | 待填写 | | |\n## 知识检索日志\n| 1 | `a` | x |\n| 2 | wiki:b.md | x |\n| 3 | c | x |\n",
    "| 护城河 | DONE | `annual.moat` | 护城河稳固持久 |\n坏公式 [calc: a/(b-b); inputs: market.close, market.pb]\n未知 [source: market.nowhere]\n市值 100亿\n",
    "```yaml\nscore: 12\n```\n⛔ VETO 已触发\n据悉订单充足 [assumption: 管理层口头确认]\n",
]


def inputs(spark):
    rng = random.Random(4)
    rows = [("A", "moat-analyst", "空"), ("A", "value-valuator", None), ("B", "moat-analyst", ""), ("C", "x", "---\n无\n---\n正文")]
    for i in range(40):
        e, c = rng.choice(["moat-analyst", "value-valuator", "macro-cyclist"]), rng.choice("ABC")
        text = "".join(rng.sample(BODIES, rng.randrange(1, 7)))
        rows.append((f"{c}", f"{e}", MATTER.format(e=e, c=c, s=rng.choice(["50", "n/a", "101"]), v=rng.choice(["PASS", "VETO", "MAYBE"])) + text + "判断" * rng.choice([0, 700])))
    rows = list({(c, e): (c, e, t) for c, e, t in rows[:4]}.values()) + [(c + str(i), e, t) for i, (c, e, t) in enumerate(rows[4:])]
    docs = spark.createDataFrame(rows, "ts_code string, expert_id string, text string")
    codes = sorted({r[0] for r in rows})
    values = [("market.close", 9.5, ""), ("market.pb", 2.0, ""), ("annual.annual_data[0].revenue_yi", 100.0, "亿"), ("annual.annual_data[1].revenue_yi", 125.0, "亿"),
              ("industry.industry_stats.roe_pct.median", 9.0, "%"), ("industry.industry_stats.roe_pct.count", 6.0, ""), ("industry.industry_stats.pe.mean", 9.0, ""),
              ("industry.industry_stats.pe.count", 3.0, ""), ("annual.moat", 1.0, "")]
    facts = spark.createDataFrame([(c, *v) for c in codes for v in values if not (c.endswith("7") and v[0] == "market.pb")], "ts_code string, path string, value double, unit string")
    sections = spark.createDataFrame([(c, 2024, "annual", "第三节 讨论与分析", "公司长期投入，研发项目。持续 推进中") for c in codes[::2]], SECTIONS)
    checklist = spark.createDataFrame([("moat-analyst", "护城河", [["annual"]]), ("value-valuator", "护城河", [["market"]])], "expert_id string, item string, token_groups array<array<string>>")
    pages = spark.createDataFrame([("a.md",), ("b",), ("b",)], "page string")
    gaps = spark.createDataFrame([(c, c < "B", False, False, False, False) for c in codes], "ts_code string, " + ", ".join(f"{n} boolean" for n, _ in K.CONTRADICTIONS))
    cards = spark.createDataFrame([(c, "20250102", "20250102", "b") for c in codes if c != "C"], "ts_code string, data_date string, analysis_date string, batch_id string")
    return docs, cards, facts, sections, checklist, pages, gaps


def test_one_pass_finds_what_the_rules_find(spark):
    docs, cards, facts, sections, checklist, pages, gaps = inputs(spark)
    paths = facts.select("ts_code", "path")
    whole = docs.withColumn("text", F.coalesce("text", F.lit("")))
    apart = D.result_problems(whole, cards).unionByName(D.content_problems(whole, sections, facts, paths, checklist, pages, gaps)).distinct()
    got = C.audit(docs, cards, facts, paths, sections, checklist, pages, gaps).collect()
    assert len(got) == len(set(got)) and set(got) == set(apart.collect())


def test_quotes_like_a_plain_search(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab，c ") for _ in range(rng.randrange(0, 300))) for _ in range(6)]
    sections = spark.createDataFrame([(c, 2024, "annual", f"s{i}x", t) for i, (c, t) in enumerate(zip("AABBCC", texts))] + [("A", 2024, "annual", "s0x", None)], SECTIONS)
    clean = [t.replace("，", "").replace(" ", "") for t in texts]
    quotes = []
    for i in range(150):
        at = rng.randrange(6)
        n = rng.randrange(6, 20)
        from_ = rng.randrange(max(1, len(clean[at]) - n))
        chunk = clean[at][from_ : from_ + n] if rng.random() < 0.5 else "".join(rng.choice("abc") for _ in range(n))
        if len(chunk) >= 6:
            quotes.append((i, "AABBCC"[at], 1, [chunk, "ccccccbbbbbbaaaaaa"], "2024", "annual", rng.choice([f"s{at}", "s", "t"])))
    df = spark.createDataFrame(quotes, "id long, ts_code string, row int, chunks array<string>, year string, kind string, section string")
    got = {r.id for r in Q.held_rows(df, sections, ["id"]).collect()}
    want = {q[0] for q in quotes if any(c == q[1] and q[6] in f"s{i}x" and any(x in t for x in q[3]) for i, (c, t) in enumerate(zip("AABBCC", clean)))}
    assert got == want and want


@pytest.mark.parametrize("many", [0, 1, 100])
def test_quotes_found_at_once_and_by_anchors(spark, many):
    """Reports asked for few passages are searched whole, others by anchors; both find the same."""
    body = "甲乙丙丁，戊己庚辛壬癸子丑寅卯"
    sections = spark.createDataFrame([("A", 2024, "annual", "第一节 概况", body), ("A", 2024, "annual", "第二节 概况", None), ("B", 2024, "annual", "概况", body)], SECTIONS)
    asked = [(0, "A", ["丙丁戊己庚辛"], "概况"), (1, "A", ["丙丁戊己庚子"], "概况"), (2, "A", ["丙丁戊己庚子", "庚辛壬癸子丑寅卯"], "第一节"),
             (3, "A", ["丙丁戊己庚辛"], "第二节"), (4, "B", ["丙丁戊己庚辛"], "概况"), (5, "C", ["丙丁戊己庚辛"], "概况")]
    df = spark.createDataFrame([(i, c, 1, q, "2024", "annual", s) for i, c, q, s in asked], "id long, ts_code string, row int, chunks array<string>, year string, kind string, section string")
    assert sorted(r.id for r in Q.held_rows(df, sections, ["id"], many=many).collect()) == [0, 2, 4]


def test_few_quotes_post_no_section(spark):
    """A report that is asked for few passages is not taken apart into anchors."""
    sections = spark.createDataFrame([("A", 2024, "annual", "概况", "甲乙丙丁戊己庚辛" * 500)], SECTIONS)
    df = spark.createDataFrame([(1, "A", 1, ["丙丁戊己庚辛"], "2024", "annual", "概况")], "id long, ts_code string, row int, chunks array<string>, year string, kind string, section string")
    found = Q.held_rows(df, sections, ["id"])
    assert found.count() == 1
    posted = []
    step = Q.postings
    try:
        Q.postings = lambda rows, *more: posted.append(rows) or step(rows, *more)
        Q.held_rows(df, sections, ["id"]).collect()
    finally:
        Q.postings = step
    assert [rows.count() for rows in posted] == [0]


def test_pages_that_exist_count_once(spark):
    log = "## 知识检索日志\n| # | 页面 |\n|---|---|\n| 1 | `a` |\n| 2 | wiki:a.md |\n| 3 | b |\n| x | c |\n| 4 | none |\n## 其他\n| 5 | c |"
    docs = spark.createDataFrame([("A", "m", log), ("A", "n", "## 其他"), ("B", "m", None)], "ts_code string, expert_id string, text string")
    pages = spark.createDataFrame([("a.md",), ("a",), ("b",), ("c",)], "page string")
    found = D.knowledge_rows(docs, pages, ["ts_code", "expert_id"])
    assert sorted(map(tuple, found.collect())) == [("A", "m", 2), ("A", "n", 0), ("B", "m", 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "count(distinct" not in plan
