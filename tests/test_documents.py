"""Sections, front matter, checklists, quotes, budgets."""

import random

from pyspark.sql import functions as F

from ledgerlens.operators import documents as D
from ledgerlens.operators import lines as L


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "ts_code string, text string")


def test_heading_split(spark):
    text = "某公司2025年年度报告\n第一节  重要提示\n内容一\n第二节 公司治理\n内容二\n第一节  重要提示\n后来的"
    got = [(r.section_name, r.section_text) for r in L.split_by_heading(docs(spark, text), ["ts_code"]).orderBy("pos").collect()]
    assert got == [("前言及目录", "某公司2025年年度报告"), ("第二节 公司治理", "内容二"), ("第一节 重要提示", "后来的")]


def test_heading_split_falls_back(spark):
    got = [(r.ts_code, r.section_name, r.section_text) for r in L.split_by_heading(docs(spark, "前言 目 录 正文在此", "只有正文"), ["ts_code"]).orderBy("ts_code", "pos").collect()]
    assert got == [("0", "重要提示及目录", "前言"), ("0", "正文", "目 录 正文在此"), ("1", "全文", "只有正文")]


def test_report_kind(spark):
    df = docs(spark, "2025年半年度报告", "2025年第三季度报告", "2025年年度报告", "x" * 2000 + "季报")
    assert [r.k for r in df.select(L.report_kind(F.col("text")).alias("k")).collect()] == ["semi_annual", "quarterly", "annual", "annual"]


def test_named_split_uses_first_heading_of_each(spark):
    text = "目录 公司治理\n第三节 经营情况讨论与分析\n讨论\n四、公司治理\n治理\n重要事项\n事项"
    got = [(r.section_name, r.section_text) for r in L.split_by_names(docs(spark, text), ["ts_code"]).orderBy("start").collect()]
    assert got == [("管理层讨论与分析", "第三节 经营情况讨论与分析\n讨论"), ("公司治理", "四、公司治理\n治理"), ("重要事项", "重要事项\n事项")]


FM = "---\nexpert_id: \"moat-analyst\"\nscore: 55\nverdict: VETO\nveto_triggers:\n  - debt\n  - \"cash\"\n---\n正文\n"


def test_front_matter_forms(spark):
    df = docs(spark, FM, "说明在前\n" + FM, "```yaml\n" + FM.replace("---\n正文", "---\n```\n正文"), "没有")
    got = L.expert_fields(df.withColumn("expert_id", F.lit("moat-analyst")), ["ts_code"]).orderBy("ts_code").collect()
    assert [(r.fm_score, r.fm_verdict, r.has_front_matter) for r in got] == [(55, "VETO", True)] * 3 + [(None, None, False)]
    assert got[0].fm_veto_triggers == ["debt", "cash"]
    strict = df.select(L.front_matter(F.col("text"), strict=True).alias("b")).collect()
    assert [bool(r.b) for r in strict] == [True, False, False, False]


def test_table_rows_with_parentheses(spark):
    text = (
        "## 叙事–数据交叉验证\n\n| # | 论述 | 证据 |\n|---|---|---|\n"
        "| 1 | 毛利改善（年报:2025/annual/经营情况讨论与分析） | `annual.annual_data[0].revenue_yi` |\n"
        "| 2 | 库存下降（年报:2025/annual/经营情况讨论与分析） | `balance.inventories_yi` |\n"
        "| 3 | 现金充裕（年报:2025/annual/经营情况讨论与分析） | `balance.cash_yi` |\n## 其他\n| 4 | a | b |"
    )
    got = {r.ts_code: r.rows for r in L.table_row_counts(docs(spark, text, "无"), ["ts_code"], D.NARRATIVE).collect()}
    assert got == {"0": 3, "1": 0}


def coverage(spark, row, item="OCF/净利润匹配", groups=(("quarterly.ocf",), ("net_profit",))):
    d = spark.createDataFrame([("A", "financial-auditor", row)], "ts_code string, expert_id string, text string")
    c = spark.createDataFrame([("financial-auditor", item, [list(g) for g in groups])], "expert_id string, item string, token_groups array<array<string>>")
    return D.checklist_coverage(d, c, ["ts_code", "expert_id"]).first()


def test_checklist_rows(spark):
    item = "OCF/净利润匹配"
    good = f"| {item} | DONE | `quarterly.ocf_ttm_yi`; `annual.annual_data[0].net_profit_yi` | OCF/NI 已核对 |"
    assert coverage(spark, good).found
    assert not coverage(spark, f"| {item} | DONE | `JSON.path` | 一句话结论 |").found
    assert not coverage(spark, good.replace("DONE", "MISSING")).found
    assert not coverage(spark, f"正文顺带提到 {item}").found
    assert not coverage(spark, good.replace("quarterly.ocf_ttm_yi", "market.close")).found
    assert not coverage(spark, good.replace("OCF/NI 已核对", "已核")).found


def quote(spark, row, times=1, section="公司坚持长期主义，推动品牌建设并持续优化产品结构。"):
    d = spark.createDataFrame([("A", D.NARRATIVE + "\n\n" + "\n".join([row] * times))], "ts_code string, text string")
    s = spark.createDataFrame([("A", 2025, "annual", "第三节 经营情况讨论与分析", section)], "ts_code string, report_year int, report_type string, section_name string, section_text string")
    p = spark.createDataFrame([("A", "annual.annual_data[0].revenue_yi")], "ts_code string, path string")
    return D.verified_quotes(d, s, p, ["ts_code"]).first().verified


ROW = (
    "| 1 | “公司坚持长期主义推动品牌建设”（年报:2025/annual/经营情况讨论与分析） | `annual.annual_data[0].revenue_yi` | ✅ | "
    "10亿 [source: annual.annual_data[0].revenue_yi] |"
)


def test_quotes(spark):
    assert quote(spark, ROW) == 1
    assert quote(spark, ROW, times=3) == 1
    assert quote(spark, ROW.replace("长期主义", "短期主义")) == 0
    assert quote(spark, ROW.replace("2025/annual", "2024/annual")) == 0
    assert quote(spark, ROW.replace("`annual.annual_data[0].revenue_yi` |", "无 |")) == 0
    assert quote(spark, ROW.replace("公司坚持长期主义推动品牌建设", "公司坚持")) == 0


def test_budget_against_brute_force(spark):
    rng = random.Random(3)
    rows = [("A" if rng.random() < 0.8 else "B", 2020 + i % 4, "annual", f"s{i:03d}", "x" * rng.choice([200, 900, 1500, 4000])) for i in range(120)]
    df = spark.createDataFrame(rows, "ts_code string, report_year int, report_type string, section_name string, section_text string")
    kept = D.within_budget(df, ["ts_code"], [F.col("report_year").desc(), F.col("section_name")], budget=9000, cap=1200)
    rows_out = kept.collect()
    assert len(rows_out) == len(rows)
    got = sorted((r.ts_code, r.section_name, r.cut) for r in rows_out if r.kept)
    want = []
    for code in "AB":
        total = 0
        for r in sorted((r for r in rows if r[0] == code), key=lambda r: (-r[1], r[3])):
            size = min(len(r[4]), 1200)
            if total + size > 9000:
                break
            total += size
            want.append((code, r[3], len(r[4]) > 1200))
    assert got == sorted(want)


def test_latest_report_prefers_the_annual(spark):
    rows = [("A", 2024, "annual"), ("A", 2025, "q1"), ("A", 2025, "semi_annual"), ("B", 2025, "notice"), ("B", 2025, "q3")]
    df = spark.createDataFrame(rows, "ts_code string, report_year int, report_type string").withColumns({"ann_date": F.lit(None).cast("date"), "title": F.lit("t")})
    assert {(r.ts_code, r.report_year, r.report_type) for r in D.latest_report(df).collect()} == {("A", 2025, "semi_annual"), ("B", 2025, "q3")}


def test_segments(spark):
    text = "开头\nexpert_id: moat-analyst\na\nb\nexpert_id: 'macro-cyclist'\nc\nexpert_id: moat-analyst\nd"
    rows = L.expert_segments(L.lines(docs(spark, text), ["ts_code"]), ["ts_code"], ["moat-analyst", "macro-cyclist"])
    assert {r.expert_id: r["count"] for r in rows.groupBy("expert_id").count().collect()} == {"moat-analyst": 5, "macro-cyclist": 2}


def test_numbered_items_and_links(spark):
    text = "## 魔鬼代言人问题库\n\n1. **利润** 从何而来\n2.  现金去了哪里\n- 不算\n## 其他\n3. 不算"
    assert [r["item"] for r in L.numbered_items(docs(spark, text), ["ts_code"], "## 魔鬼代言人问题库").orderBy("line").collect()] == ["利润 从何而来", "现金去了哪里"]
    links = L.page_links(docs(spark, "见 [[护城河|词条]] 与 [[估值]]，再见 [[护城河]]"), ["ts_code"])
    assert sorted(r.page for r in links.collect()) == ["估值", "护城河"]


def test_content_rules_find_an_empty_result(spark):
    keys = "ts_code string, expert_id string, text string"
    d = spark.createDataFrame([("A", "moat-analyst", "空")], keys)
    sections = spark.createDataFrame([], "ts_code string, report_year int, report_type string, section_name string, section_text string")
    facts = spark.createDataFrame([("A", 0, "market.close", 1.0, "")], "ts_code string, ord int, path string, value double, unit string")
    checklist = spark.createDataFrame([("moat-analyst", "护城河", [["annual"]])], "expert_id string, item string, token_groups array<array<string>>")
    pages = spark.createDataFrame([("valuation",)], "page string")
    gaps = spark.createDataFrame([("A", True, True, True, True, True)], "ts_code string, goodwill_unknown boolean, debt_unknown boolean, fcf_incomplete boolean, macro_missing boolean, not_cross_validated boolean")
    got = {r.rule_id for r in D.content_problems(d, sections, facts, facts.select("ts_code", "path"), checklist, pages, gaps).collect()}
    assert got == {"R18", "R19", "R21", "R22", "R24"}
