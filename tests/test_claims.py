"""Claims: finding numbers, binding evidence, tracing, assertions.  Vectors are literal."""

from ledgerlens.bindings import fundamentals, texts
from ledgerlens.functions import values as V
from ledgerlens.operators import claims as C

FACTS = "ts_code string, ord int, path string, value double, unit string"


def found(spark, text):
    docs = spark.createDataFrame([("A", text)], "ts_code string, text string")
    return C.claims(docs, ["ts_code"])


def listed(spark, text):
    rows = found(spark, text).orderBy("line", "pos").collect()
    return [(r.value, r.unit, r.category) for r in rows]


def facts(spark, **paths):
    rows = [("A", i, p.replace("__", "."), float(v), None) for i, (p, v) in enumerate(paths.items())]
    df = spark.createDataFrame(rows, FACTS)
    return df.withColumn("unit", V.infer_unit("path"))


def fact_rows(spark, pairs):
    return spark.createDataFrame([("A", i, p, float(v), None) for i, (p, v) in enumerate(pairs)], FACTS).withColumn(
        "unit", V.infer_unit("path")
    )


def statuses(spark, text, pairs):
    traced = C.trace(found(spark, text), fact_rows(spark, pairs), ["ts_code"])
    return [r.trace_status for r in traced.orderBy("line", "pos").collect()]


def test_six_digit_fact_is_not_a_company_code(spark):
    assert listed(spark, "营收为123456元，用户数123456") == [(123456.0, "元", "data"), (123456.0, "", "data")]
    assert listed(spark, "股票代码：603605；标的 603605.SH") == []


def test_units_and_unitless_ratios(spark):
    assert listed(spark, "市值 1234.56亿 [source: market.total_mv_yi]") == [(1234.56, "亿", "data")]
    assert listed(spark, "PE 999") == [(999.0, "", "data")]
    assert [c for _, _, c in listed(spark, "PE 8.5，PB 2.0，流动比率 1.2")] == ["data"] * 3


def test_percentage_points_ordinals_and_ranges(spark):
    text = (
        "1. GDP变化 -0.40 个百分点 [calc: current-previous; inputs: macro.current_pct,macro.previous_pct]\n"
        "2. 低 PE 不是安全边际\n"
        "仓位低配约 10—15 个百分点 [assumption: 相邻周期仓位差的压力估计]"
    )
    rows = found(spark, text).orderBy("line", "pos").collect()
    assert [(r.line, r.value, r.unit, r.category) for r in rows] == [
        (1, -0.4, "%", "data"), (3, 10.0, "", "assumption"), (3, 15.0, "%", "assumption"),
    ]


def test_meta_sections_blocks_and_tables(spark):
    assert "data" not in [c for *_, c in listed(spark, "## 质询问题\n\n1. 如果行业基准调严 20%，结论是否变化？")]
    assert [(v, u) for v, u, c in listed(
        spark, "## 综合裁决 — 裁判长\n\n### 裁决理由\n\n公司营收为 999亿，但没有给出数据定位。") if c == "data"] == [(999.0, "亿")]
    yaml = listed(spark, "## 综合裁决 — 裁判长\n\n```yaml\nfinancial_auditor: { score: 80, verdict: PASS }\n```\n")
    assert yaml and {c for *_, c in yaml} == {"meta"}
    table = "| 专家 | 评分 | 权重 | 贡献 |\n|---|---:|---:|---:|\n| financial-auditor | 80 | 0.25 | 20.00 |"
    assert "data" not in [c for *_, c in listed(spark, table)]


def test_table_header_needs_a_ruler_and_ends_with_the_block(spark):
    text = "| 序号 | 值 |\n|---|---|\n| 77 | 88 |\n\n正文 66\n| 99 | 55 |"
    assert [(v, c) for v, _, c in listed(spark, text)] == [(88.0, "data"), (66.0, "data"), (55.0, "data")]


def test_array_paths_are_kept_whole():
    line = (
        "收入 100亿 [source: annual.annual_data[0].revenue_yi]；增速 20% [calc: (current/previous-1)*100; inputs: "
        "annual.annual_data[1].revenue_yi,annual.annual_data[0].revenue_yi]"
    )
    first, second = C.scan_line(line)
    assert first["sources"] == ["annual.annual_data[0].revenue_yi"]
    assert second["formulas"][0]["inputs"] == ["annual.annual_data[1].revenue_yi", "annual.annual_data[0].revenue_yi"]


def test_exact_path_and_unit(spark):
    assert statuses(spark, "市值 100亿 [source: market.total_mv_yi]", [("market.total_mv_yi", 100)]) == ["DIRECT"]


def test_wrong_path_or_unit_is_untraced_with_a_hint(spark):
    pairs = [("market.total_mv_yi", 100), ("market.pe_ttm", 100)]
    text = "值 100亿 [source: market.pe_ttm]"
    assert statuses(spark, text, pairs) == ["UNTRACED"]
    traced = C.trace(found(spark, text), fact_rows(spark, pairs), ["ts_code"])
    hints = C.value_only_candidates(traced, fact_rows(spark, pairs), ["ts_code"]).collect()
    assert [h.path for h in hints] == ["market.total_mv_yi"]


def test_swapped_tags_and_near_values(spark):
    text = "收入 100亿 [source: annual.profit_yi]；利润 5亿 [source: annual.revenue_yi]"
    assert statuses(spark, text, [("annual.revenue_yi", 100), ("annual.profit_yi", 5)]) == ["UNTRACED"] * 2
    text = "收入 100亿 [source: annual.profit_yi]；利润 101亿 [source: annual.revenue_yi]"
    assert statuses(spark, text, [("annual.revenue_yi", 100), ("annual.profit_yi", 100.9)]) == ["UNTRACED"] * 2


def test_derived_values(spark):
    pairs = [("annual.current_yi", 120), ("annual.previous_yi", 100)]
    tag = "[calc: (current/previous-1)*100; inputs: annual.current_yi, annual.previous_yi]"
    assert statuses(spark, f"增速 20% {tag}", pairs) == ["DERIVED"]
    assert statuses(spark, f"增速 99% {tag}", pairs) == ["UNTRACED"]
    assert statuses(spark, f"增速 20亿 {tag}", pairs) == ["UNTRACED"]


def test_formulas_must_depend_on_every_input():
    assert C.recompute("999", [100.0]) is None
    assert C.recompute("a+b-b", [20.0, 100.0]) is None
    assert C.recompute("a", [20.0]) is None
    assert C.recompute("profit", [20.0]) is None
    assert C.recompute("__import__('os')", [1.0]) is None
    assert C.recompute("9**9**9*a", [1.0]) is None
    assert abs(C.recompute("current/previous*100", [20.0, 100.0]) - 20) < 1e-12
    assert abs(C.recompute("sqrt(a^2+b^2)", [3.0, 4.0]) - 5) < 1e-12


def test_peer_figures_need_five_peers(spark):
    text = "同业中位 50% [source: industry.industry_stats.gross_margin_pct.median]"
    path = "industry.industry_stats.gross_margin_pct"
    assert statuses(spark, text, [(path + ".median", 50), (path + ".count", 4)]) == ["UNTRACED"]
    assert statuses(spark, text, [(path + ".median", 50), (path + ".count", 5)]) == ["DIRECT"]


def flagged(spark, line, pairs):
    docs = spark.createDataFrame([("A", line)], "ts_code string, text string")
    return [r.label for r in C.unsupported_assertions(docs, fact_rows(spark, pairs), ["ts_code"]).collect()]


def test_facts_are_told_from_each_other_before_they_are_joined(spark):
    """Only counts of peers meet the sample check, only history meets statements about history."""
    pairs = [("industry.industry_stats.roe_pct.median", 9), ("industry.industry_stats.roe_pct.count", 4), ("market.close", 3)]
    known = fact_rows(spark, pairs)
    text = "行业平均 ROE 9% [source: industry.industry_stats.roe_pct.median]\n营收创历史新高 [source: annual.rows[0].revenue_yi]"
    traced = C.trace(found(spark, text), known, ["ts_code"])
    loose = C.unsupported_assertions(spark.createDataFrame([("A", text)], "ts_code string, text string"), known, ["ts_code"])
    assert [r.trace_status for r in traced.collect()] == ["UNTRACED"]
    assert sorted(r.label for r in loose.collect()) == ["history", "industry"]
    for out in (traced, loose):
        assert "StartsWith(path" in (plan := out._jdf.queryExecution().optimizedPlan().toString()), plan
    assert "metric" not in loose._jdf.queryExecution().optimizedPlan().toString()


def test_unsupported_assertions(spark):
    path = "industry.industry_stats.gross_margin_pct"
    line = f"行业平均毛利率可参考中位数 [source: {path}.median]"
    assert flagged(spark, line, [(path + ".median", 50), (path + ".count", 4)]) == ["industry"]
    assert flagged(spark, line, [(path + ".median", 50), (path + ".count", 5)]) == []
    assert flagged(spark, "行业平均明显更低 [source: market.close]", [("market.close", 1)]) == ["industry"]
    assert flagged(spark, "据统计，市场普遍看好", [("market.close", 1)]).sort() == ["hearsay", "market_consensus"].sort()


def test_history_needs_every_year(spark):
    series = [(f"annual.annual_data[{i}].revenue_yi", i) for i in range(3)]
    every = ", ".join(p for p, _ in series)
    assert flagged(spark, f"营收创历史新高 [source: {every}]", series) == []
    assert flagged(spark, f"营收创历史新高 [source: {series[0][0]}, {series[1][0]}]", series) == ["history"]


def test_contradictions_respect_hedges(spark):
    docs = spark.createDataFrame([("A", "公司零商誉，自由现金流充裕。商誉未知，不能说零商誉")], "ts_code string, text string")
    gaps = spark.createDataFrame(
        [("A", True, False, True, False, False)],
        "ts_code string, goodwill_unknown boolean, debt_unknown boolean, fcf_incomplete boolean, macro_missing boolean, not_cross_validated boolean",
    )
    got = sorted(r.label for r in C.contradictions(docs, gaps, ["ts_code"]).collect())
    assert got == ["fcf_incomplete", "goodwill_unknown"]


def test_verdicts(spark):
    rows = [("a", 95.0, 0, 0, 0, 0, 85.0, 2), ("b", 80.0, 3, 0, 0, 0, 65.0, 0), ("c", 80.0, 3, 0, 0, 0, 55.0, 0)]
    df = spark.createDataFrame(
        rows, "d string, trace_pct double, untraced int, unsourced int, date_issues int, identity_issues int, checklist_pct double, checklist_done int")
    assert [r.verdict for r in C.report_verdicts(df).orderBy("d").collect()] == ["PASS", "FLAGGED", "FAIL"]


def test_first_traceable(spark):
    text = "PE 10\n市值 100亿 [source: market.total_mv_yi]\n利润 3亿 [source: annual.profit_yi]"
    row = C.first_traceable(found(spark, text), ["ts_code"]).first()
    assert (row.raw, row.path) == ("100亿", "market.total_mv_yi")


def test_label_longest_wins(spark):
    df = spark.createDataFrame([("公司自由现金流 ",), ("市值与营收 ",), ("PE ",)], "local_prefix string")
    got = [r.labels for r in C.with_labels(df).collect()]
    assert got[0] == [["fcf"]] and len(got[1]) == 2 and got[2] == [["pe"]]


def test_invalid_formulas(spark):
    text = "增速 20% [calc: a/b; inputs: m.a, m.b] 与 [calc: a+999-a; inputs: m.a]\n[calc: a*2; inputs: m.x]\n[calc: 5]"
    docs = spark.createDataFrame([("A", text)], "ts_code string, text string")
    got = C.invalid_formulas(docs, fact_rows(spark, [("m.a", 1), ("m.b", 2)]), ["ts_code"]).collect()
    assert sorted((r.line, r.formula) for r in got) == [(1, "a+999-a"), (2, "a*2"), (3, "5")]


# --- registered reports --------------------------------------------------------------------


def test_candidates_come_from_every_section(spark):
    sf = "/root/testdata/sf0.001"
    facts = fundamentals.company_facts(spark, sf).collect()
    open_ = texts._report_tables(spark, sf)["traced"].where("trace_status = 'UNTRACED' and category = 'data'").collect()
    want = set()
    for c in open_:
        tolerance = 0.5 * 10.0 ** -len(c.raw.partition(".")[2].rstrip("亿万%"))
        for f in facts:
            if (f.ts_code, f.unit) == (c.ts_code, c.unit) and abs(f.value - c.value) <= tolerance + 1e-12:
                want.add((c.ts_code, c.line, c.pos, f.path))
    got = {(r.ts_code, r.line, r.pos, r.path) for r in texts.claim_candidates(spark, sf).collect()}
    assert got == want
    held = {r.path.partition(".")[0].partition("[")[0] for r in texts._report_tables(spark, sf)["card_facts"].select("path").distinct().collect()}
    assert {"quarterly", "indicators", "forecast"} <= held


def test_quotes_stand_anywhere_in_the_document(spark):
    rows = texts._write_quoting(spark, "/root/testdata/sf0.001").where("length(section_text) > 100 and text not like '%ZZQQ%'").collect()
    at = [r.section_text.index(r.text.partition("“")[2].partition("”")[0]) / len(r.section_text) for r in rows]
    assert min(at) < 0.1 and max(at) > 0.7 and any(0.3 < x < 0.6 for x in at)
