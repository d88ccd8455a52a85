"""Quality rules on whole documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import jsonwalk
from ledgerlens.operators import quality as Q
from ledgerlens.plans import snapshot
from ledgerlens.sources import tables

SCHEMA = """ts_code string, stock_info struct<name:string>,
 market struct<ts_code:string,trade_date:string,close:double,total_mv_yi:double,total_shares_yi:double>,
 annual struct<annual_data:array<struct<year:int,revenue_yi:double,net_profit_yi:double,non_recurring_pct:double>>,count:int,last_year:int,
  revenue_cagr_full_pct:double,revenue_cagr_5y_pct:double,profit_cagr_full_pct:double,profit_cagr_5y_pct:double>,
 quarterly struct<periods:array<struct<period:string,quarter:int,source_statement_kind:struct<income:string,cashflow:string>,revenue_yi:double,net_profit_yi:double,ocf_yi:double,capex_yi:double,fcf_yi:double>>,
  ocf_ttm_complete:boolean,ttm_complete:boolean,ocf_ttm_yi:double,cap_ex_ttm_yi:double,fcf_ttm_yi:double>,
 balance struct<ts_code:string,end_date:string,total_assets_yi:double,equity_yi:double,cash_yi:double,goodwill_yi:double,interest_debt_yi:double>,
 indicators struct<indicators:array<struct<year:int,roe_pct:double,gross_margin_pct:double,net_margin_pct:double,debt_ratio_pct:double>>,count:int>,
 audit struct<has_audit:boolean,latest:struct<end_date:string,audit_result:string>>,
 industry struct<industry_stats:map<string,struct<count:int>>,comparison_fiscal_year:int,comparison_trade_date:string>,
 macro struct<available:boolean>"""


def document(**changes):
    period = lambda p, q: dict(period=p, quarter=q, source_statement_kind=dict(income="ytd", cashflow="ytd"), revenue_yi=10.0,
                               net_profit_yi=2.0, ocf_yi=3.0, capex_yi=1.0, fcf_yi=2.0)
    doc = dict(
        ts_code="600519.SH", stock_info=dict(name="name"),
        market=dict(ts_code="600519.SH", trade_date="20260612", close=10.0, total_mv_yi=100.0, total_shares_yi=10.0),
        annual=dict(annual_data=[dict(year=y, revenue_yi=40.0, net_profit_yi=8.0, non_recurring_pct=1.0) for y in (2023, 2024, 2025)], count=3,
                    last_year=2025, revenue_cagr_full_pct=0.0, revenue_cagr_5y_pct=None, profit_cagr_full_pct=0.0, profit_cagr_5y_pct=None),
        quarterly=dict(periods=[period("20260331", 1), period("20251231", 4), period("20250930", 3), period("20250630", 2)], ocf_ttm_complete=True,
                       ttm_complete=True, ocf_ttm_yi=12.0, cap_ex_ttm_yi=4.0, fcf_ttm_yi=8.0),
        balance=dict(ts_code="600519.SH", end_date="20251231", total_assets_yi=90.0, equity_yi=50.0, cash_yi=5.0, goodwill_yi=1.0, interest_debt_yi=2.0),
        indicators=dict(indicators=[dict(year=2025, roe_pct=1.0, gross_margin_pct=1.0, net_margin_pct=1.0, debt_ratio_pct=1.0)], count=1),
        audit=dict(has_audit=True, latest=dict(end_date="20251231", audit_result="standard")),
        industry=dict(industry_stats={"roe_pct": dict(count=9)}, comparison_fiscal_year=2025, comparison_trade_date="20260612"),
        macro=dict(available=True),
    )
    for path, value in changes.items():
        node = doc
        *head, leaf = path.split("__")
        for h in head:
            node = node[int(h)] if h.isdigit() else node[h]
        node[leaf] = value
    return doc


def problems(spark, *docs):
    df = spark.read.schema(SCHEMA).json(spark.sparkContext.parallelize([json.dumps(d) for d in docs]))
    rows = Q.with_problems(df, F.lit("2026-06-15").cast("date")).collect()
    return [[(p.rule_id, p.severity) for p in r.problems] for r in rows]


def test_a_sound_document_passes(spark):
    assert problems(spark, document()) == [[]]


def test_unknown_parts_warn(spark):
    got = problems(spark, document(balance__goodwill_yi=None, balance__cash_yi=None, balance__interest_debt_yi=None, macro__available=False))
    assert got == [[("DQ31", "W"), ("DQ32", "W"), ("DQ33", "W"), ("DQ41", "W")]]


@pytest.mark.parametrize("rule,change", [
    ("DQ1", dict(stock_info__name="")),
    ("DQ3", dict(market__ts_code="000001.SZ")),
    ("DQ5", dict(market__close=None)),
    ("DQ7", dict(market__trade_date="20260616", industry__comparison_trade_date="20260616")),
    ("DQ9", dict(annual__count=4)),
    ("DQ12", dict(annual__last_year=2024)),
    ("DQ14", dict(annual__annual_data__2__revenue_yi=None, annual__revenue_cagr_full_pct=0.0)),
    ("DQ15", dict(annual__profit_cagr_5y_pct=3.0)),
    ("DQ18", dict(quarterly__periods__0__quarter=2)),
    ("DQ21", dict(quarterly__periods__1__net_profit_yi=None)),
    ("DQ22", dict(quarterly__ocf_ttm_complete=False)),
    ("DQ23", dict(quarterly__ocf_ttm_yi=12.06)),
    ("DQ24", dict(quarterly__periods__3__fcf_yi=2.1)),
    ("DQ25", dict(quarterly__fcf_ttm_yi=None)),
    ("DQ29", dict(balance__end_date="20241231")),
    ("DQ30", dict(balance__equity_yi=None)),
    ("DQ34", dict(indicators__indicators__0__roe_pct=None)),
    ("DQ35", dict(audit__latest__audit_result="")),
    ("DQ36", dict(audit__latest__end_date="20241231")),
    ("DQ37", dict(market__total_mv_yi=106.0)),
    ("DQ40", dict(industry__comparison_fiscal_year=2024)),
])
def test_errors(spark, rule, change):
    found = problems(spark, document(**change))[0]
    assert (rule, "E") in found


def test_codes_years_and_gaps(spark):
    bad_code = document(ts_code="700001", market__ts_code="700001", balance__ts_code="700001")
    years = document(annual__annual_data__0__year=2024, annual__annual_data__1__year=2024)
    unsorted = document(annual__annual_data__0__year=2024, annual__annual_data__1__year=2023)
    gap = document(quarterly__periods__3__period="20250331", quarterly__periods__3__quarter=1, quarterly__ocf_ttm_complete=False)
    got = problems(spark, bad_code, years, unsorted, gap)
    assert ("DQ2", "E") in got[0] and got[0].count(("DQ3", "E")) == 8
    assert ("DQ10", "E") in got[1] and ("DQ11", "E") in got[2]
    assert ("DQ19", "E") in got[3] and ("DQ22", "E") in got[3]


def test_warnings(spark):
    got = problems(
        spark, document(quarterly__periods__0__capex_yi=None), document(quarterly__ttm_complete=False),
        document(industry__industry_stats={"pb": dict(count=4)}), document(industry__industry_stats=None),
        document(annual__annual_data__0__non_recurring_pct=None),
        document(quarterly__periods__2__source_statement_kind__income="inferred_ytd"),
    )
    assert [[("DQ26", "W")], [("DQ26", "W")], [("DQ39", "W")], [("DQ38", "W")], [("DQ42", "W")], [("DQ27", "W")]] == got


def test_empty_sections_fail(spark):
    row = document()
    for section in ("market", "annual", "quarterly", "balance", "indicators", "audit", "industry"):
        row[section] = None
    found = problems(spark, row)[0]
    assert {r for r, s in found if s == "E"} >= {"DQ3", "DQ4", "DQ8", "DQ17", "DQ28", "DQ34", "DQ35", "DQ36"}


def test_stored_verdicts(spark):
    df = spark.read.schema(SCHEMA).json(spark.sparkContext.parallelize([json.dumps(document())]))
    on = F.lit("2026-06-15").cast("date")
    stored = Q.with_verdict(df, on)
    assert stored.first().data_quality.status == "PASS"
    assert Q.declared_differs(stored, on).count() == 0
    forged = stored.withColumn("data_quality", F.col("data_quality").withField("status", F.lit("WARN")))
    assert Q.declared_differs(forged, on).count() == 1
    got = forged.select(Q.envelope_problems(F.col("data_quality")).alias("p")).first().p
    assert got == ["warn_without_warnings"]


def test_facts_and_paths(spark):
    df = spark.createDataFrame(
        [("A", (1.5, [(10.0, None), (20.0, float("nan"))], {"roe": (3,)}))],
        "ts_code string, s struct<a_yi:double, rows:array<struct<x_pct:double,y:double>>, m:map<string,struct<count:int>>>",
    )
    got = [(r.path, r.value, r.unit) for r in snapshot.facts(df).orderBy("ord").collect()]
    assert got == [("s.a_yi", 1.5, "亿"), ("s.rows[0].x_pct", 10.0, "%"), ("s.rows[1].x_pct", 20.0, "%"), ("s.m.roe.count", 3.0, "")]
    assert {r.path for r in snapshot.paths(df).collect()} == {
        "s", "s.a_yi", "s.rows", "s.rows[0]", "s.rows[0].x_pct", "s.rows[1]", "s.rows[1].x_pct", "s.rows[1].y", "s.m", "s.m.roe", "s.m.roe.count"}


def test_facts_of_foreign_json(spark):
    docs = spark.createDataFrame([("A", json.dumps({"market": {"close": 10, "name": "x"}, "rows": [{"v_yi": 1.5}, {"v_yi": None}]}))], "ts_code string, json string")
    got = {(r.path, r.value, r.unit) for r in snapshot.json_facts(docs, ("ts_code",)).collect()}
    assert got == {("market.close", 10.0, ""), ("rows[0].v_yi", 1.5, "亿")}


def test_facts_of_deep_documents_are_all_found(spark):
    inner = 1
    for k in range(11):
        inner = {f"k{k}": inner, f"v{k}": k, "s": '{"[', "a": [k, {"b": k}]}
    docs = spark.createDataFrame([("A", json.dumps(inner)), ("B", "[[1]]"), ("C", None), ("D", "no json {")], "ts_code string, json string")
    got = snapshot.json_facts(docs, ("ts_code",)).collect()
    assert sum(r.ts_code == "A" for r in got) == 1 + 11 * 3
    assert [r.path for r in got if r.ts_code == "B"] == ["[0][0]"]


def test_nodes_of_json_are_those_of_its_parsed_form(spark):
    def flat(x, path=""):
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(x), "number")
        yield path, kind, float(x) if kind == "number" else None
        inner = x.items() if kind == "object" else enumerate(x) if kind == "array" else ()
        for k, v in inner:
            yield from flat(v, f"{path}[{k}]" if kind == "array" else f"{path}.{k}" if path else k)

    rng = random.Random(4)

    def tree(depth):
        make = rng.randrange(9 if depth else 6)
        if make < 6:
            return [1, -2.5e3, "a\"]{\n", True, None, "é\u2028"][make]
        return [tree(depth - 1) for _ in range(rng.randrange(4))] if make == 6 else {rng.choice(["k", "", "a b", "é", "x.y"]): tree(depth - 1) for _ in range(3)}

    made = [tree(6) for _ in range(300)]
    for x in made:
        assert list(jsonwalk.walk(json.dumps(x, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])))) == list(flat(x))
    for wrong in ("", " ", "{", "[1,]", "[,1]", '{"a":1,}', '{"a" 1}', "{a:1}", "1 2", "[1}", "nul", "01", "+1", "[1 2]", '{"a"}', '"a', "]", "}", '["\n"]', "NaN", ",", "{,}"):
        assert list(jsonwalk.found(wrong)) == [], wrong
    depth = 30_000
    assert list(jsonwalk.found("[" * 300 + "7" + "]" * 300))[-1] == ("[0]" * 300, "number", 7.0)
    assert list(jsonwalk.found("[" * depth + "7" + "]" * depth, ("number",))) == [("[0]" * depth, "number", 7.0)]
    assert list(jsonwalk.found("[" * 300_000)) == []
    df = spark.createDataFrame([("A", json.dumps(made[k % 300])) for k in range(40)] + [("B", '{"\\ud800":1e999}'), ("C", None)], "ts_code string, json string")
    rows = jsonwalk.nodes(df, ("ts_code",)).collect()
    assert sum(r.ts_code == "A" for r in rows) == sum(len(list(flat(x))) for x in made[:40]) and not any(r.ts_code == "C" for r in rows)
    assert [(r.path, r.kind) for r in rows if r.ts_code == "B"] == [("", "object"), ("?", "number")]
    assert {r.path for r in snapshot.json_paths(df.where("ts_code = 'B'"), ("ts_code",)).collect()} == {"?"}


def test_paths_of_json_are_told_apart_where_they_are_walked(spark, monkeypatch):
    """Rows that share keys (also none), keys that an object repeats, paths that keys with dots make equal, short and long texts."""
    monkeypatch.setattr(jsonwalk, "SHORT_CHARS", 40)
    rows = [("A", '{"a": 1, "a": {"b": 2}, "a.b": 3}'), ("B", '{"x": [1, 2]}'), ("B", '{"x": [1], "y": 2}'), (None, '{"n": 1}'), (None, '{"n": 2, "m": 3}'),
            ("C", '{"k": "' + "long " * 20 + '", "k": 1}'), ("D", None), ("E", "{"), ("F", "7")]
    df = spark.createDataFrame(rows, "ts_code string, json string")
    out = snapshot.json_paths(df, ("ts_code",))
    assert sorted((r.ts_code or "", r.path) for r in out.collect()) == [
        ("", "m"), ("", "n"), ("A", "a"), ("A", "a.b"), ("B", "x"), ("B", "x[0]"), ("B", "x[1]"), ("B", "y"), ("C", "k")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")  # no exchange of all paths


def test_parsed_json_is_told_like_walked_json(monkeypatch):
    texts = ['{"a":[' * 700 + "7,8" + "]}" * 700, '{"":{"":1,"b":[]},"a":{},"a":-0}', '[1E400, "\\ud800", {"\\ud800": null}]', "[" * 20_000 + "]" * 20_000, "[NaN]", "[1]x"]
    told = [list(jsonwalk.found(x, ("number", "null"))) for x in texts]
    assert len(told[0]) == 1400 // 700 and not told[4] and not told[5]
    monkeypatch.setattr(jsonwalk, "OPEN_CHARS", 1000)
    assert repr([list(jsonwalk.found(x, ("number", "null"))) for x in texts]) == repr(told)
    monkeypatch.setattr(jsonwalk, "WHOLE_CHARS", 0)
    assert repr([list(jsonwalk.found(x, ("number", "null"))) for x in texts]) == repr(told)


def test_json_is_strict_at_any_depth(spark, tmp_path):
    nan = float("nan")
    df = spark.createDataFrame([("A", (nan, [float("inf"), 1.0], {"k": nan}))], "ts_code string, s struct<x:double,a:array<double>,m:map<string,double>>")
    tables.write_json_documents(df, f"{tmp_path}/out")
    row = json.loads(spark.read.text(f"{tmp_path}/out").first().value)
    assert row == {"ts_code": "A", "s": {"x": None, "a": [None, 1.0], "m": {"k": None}}}
