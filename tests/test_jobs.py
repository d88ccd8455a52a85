"""Ingest, scoring, logs, integrity, screening, streaming."""

import datetime as dt
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import integrity as I
from ledgerlens.operators import runs as R
from ledgerlens.operators import scoring as SC
from ledgerlens.operators import screening as X
from ledgerlens.runtime import shared_dir
from ledgerlens.schema import EXPERTS, column_names
from ledgerlens.sources import ingest as G
from ledgerlens.sources import tables as T
from ledgerlens.streaming import run_health as RH


# --- ingest --------------------------------------------------------------------------------


def test_text_gaps(spark):
    reports = spark.createDataFrame([("A", y, "x" * 1000) for y in (2022, 2023, 2024)] + [("B", 2024, "x" * 999), ("C", 2025, "x" * 1000)],
                                    "ts_code string, report_year int, section_text string")
    companies = spark.createDataFrame([("A",), ("B",), ("C",)], "ts_code string")
    got = sorted((r.ts_code, r.report_year) for r in G.text_gaps(companies, G.loaded_years(reports), F.lit(2025)).collect())
    assert got == [("A", 2025), ("B", 2023), ("B", 2024), ("B", 2025), ("C", 2023), ("C", 2024)]


def test_snapshot_speaks_only_for_its_day(spark):
    quotes = spark.createDataFrame([("A", dt.date(2026, 6, 12), 9.0), ("B", dt.date(2026, 5, 1), 8.0)], "ts_code string, trade_date date, close double")
    snap = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "ts_code string, pb double")
    stamp = lambda at, day: G.date_quote_snapshot(snap, quotes, F.lit(at).cast("timestamp"), F.lit(day).cast("date")).collect()
    got = stamp("2026-06-15 16:30:00", "2026-06-15")  # a Monday
    assert [(r.ts_code, r.trade_date, r.close) for r in got] == [("A", dt.date(2026, 6, 12), 9.0)]
    assert stamp("2026-06-15 15:59:00", "2026-06-15") == []
    assert stamp("2026-06-15 16:30:00", "2026-06-12") == []
    assert len(stamp("2026-06-14 09:00:00", "2026-06-14")) == 1  # a Sunday


def test_date_column_by_name_and_by_shape(spark):
    assert G.find_date_column(spark.createDataFrame([("a", "b")], "`x` string, `报告期末日期` string")) == "报告期末日期"
    assert G.find_date_column(spark.createDataFrame([("2025-12-31", "b")], "p string, q string")) == "p"
    assert G.find_date_column(spark.createDataFrame([("total", "b")], "p string, q string")) is None


def test_refresh_refuses_an_empty_list(spark):
    with pytest.raises(ValueError):
        G.refresh_companies(spark.createDataFrame([], "ts_code string, n int"), [F.col("n")])


def test_two_headings_for_one_column(spark):
    a, b = [h for h, n in G.CASHFLOW_HEADINGS.items() if n == "c_pay_acq_const_fiolta"]
    df = spark.createDataFrame([("x", None, "1,000"), ("y", "5", None)], f"ts_code string, `{a}` string, `{b}` string")
    assert [r.c_pay_acq_const_fiolta for r in G.harmonize(df, G.CASHFLOW_HEADINGS, ["ts_code"]).collect()] == [1000.0, 5.0]


def test_stored_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", dt.date(2025, 12, 31), "1", 5.0, "extra")], "ts_code string, end_date date, report_type string, total_revenue double, other string")
    T.write_table(df, str(tmp_path), "income")
    newer = df.withColumn("end_date", F.lit("2026-03-31").cast("date"))
    T.write_table(newer, str(tmp_path), "income", changed_partitions_only=True)
    back = T.read_table(spark, str(tmp_path), "income")
    assert sorted(r.fiscal_year for r in back.collect()) == [2025, 2026]
    assert back.columns == [*column_names("income"), "fiscal_year"]
    assert T.shared_columns(df, column_names("income")).columns == ["ts_code", "end_date", "report_type", "total_revenue"]


def test_strict_json_documents(spark, tmp_path):
    df = spark.createDataFrame([("A", float("nan"), 1.0)], "ts_code string, x double, y double")
    T.write_json_documents(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"ts_code":"A","x":null,"y":1.0}'


def test_reports_and_logs_from_files(spark, tmp_path):
    (tmp_path / "invest_result_600519.SH_moat-analyst.md").write_text("---\nscore: 5\n---\nx\n", encoding="utf-8")
    row = T.read_reports(spark, str(tmp_path / "*.md")).first()
    assert (row.ts_code, row.expert_id, row.text[:3]) == ("600519.SH", "moat-analyst", "---")
    log = tmp_path / "t.jsonl"
    log.write_text('{"ts":"2026-06-15T01:00:00Z","code":"6","phase":"sync","status":"ok"}\nbroken\n\n'
                   '{"ts":"??","code":"6","status":"ok"}\n{"ts":"2020-01-01T00:00:00Z","code":"7","status":"ok"}\n')
    events = T.read_events(spark, str(log))
    assert events.count() == 3
    kept = T.events_since(events, F.lit("2026-01-01T00:00:00Z").cast("timestamp"))
    assert sorted((r.code, r.at is None) for r in kept.collect()) == [("6", False), ("6", True)]


# --- scoring -------------------------------------------------------------------------------

RULES = SC.Scoring(
    weights={"financial-auditor": 0.2, "value-valuator": 0.2, "growth-assessor": 0.15, "moat-analyst": 0.15, "management-auditor": 0.15, "macro-cyclist": 0.15},
    tiers=(SC.Tier(80, "BUY", 20), SC.Tier(60, "OBSERVE", 10), SC.Tier(0, "AVOID", 0)),
    veto_rules={"macro-cyclist": ("OBSERVE", "AVOID")}, macro_veto_cap=5.0,
)
RES = "ts_code string, run_id string, industry string, created_at timestamp, expert_id string, score int, verdict string, conclusion_direction string"


def results(spark, runs):
    """runs: run_id -> per role (score, verdict, direction)"""
    rows = [("A", run, "X", dt.datetime(2026, 1, 1 + i), e, *v) for i, (run, votes) in enumerate(runs.items()) for e, v in zip(EXPERTS, votes)]
    return spark.createDataFrame(rows, RES)


def test_severe_split_escalates(spark):
    votes = [(50, v, None) for v in ("PASS", "PASS", "VETO", "WARN", "WARN", "WARN", "WARN")]
    row = SC.escalations(results(spark, {"r": votes}), RULES).first()
    assert row.severe_split and row.triggered and not row.industry_opposition
    assert row.composite_score == 40.0 and not row.score_below_40  # 50 x 0.8


def test_three_runs_of_opposition(spark):
    votes = [(70, "PASS", "NEGATIVE" if e == "value-valuator" else "POSITIVE") for e in EXPERTS]
    r = results(spark, {"a": votes, "b": votes, "c": votes})
    row = SC.industry_opposition(r).first()
    assert (row.opposed_experts, row.opposition, row.status) == ("value-valuator", True, "EVALUATED_3_RUNS")
    assert all(x.triggered for x in SC.escalations(r, RULES).collect())
    row = SC.industry_opposition(results(spark, {"a": votes, "b": votes})).first()
    assert not row.opposition and row.status == "INSUFFICIENT_VERIFIED_HISTORY_2_OF_3"


def test_ties_have_no_majority(spark):
    votes = [(70, "PASS", d) for d in ("POSITIVE",) * 3 + ("NEGATIVE",) * 4]
    r = SC.run_directions(results(spark, {"a": votes}))
    assert sorted(r.select(F.explode(SC.opposed_experts(F.col("directions")))).toPandas()["col"]) == sorted(EXPERTS[:3])


def test_a_missing_score_leaves_no_total(spark):
    votes = [(70, "PASS", "POSITIVE")] * 6 + [(None, "PASS", "POSITIVE")]
    row = SC.composite(results(spark, {"a": votes}), RULES).first()
    assert not row.complete and row.raw is None and row.adjusted is None
    votes[6] = (101, "PASS", "POSITIVE")
    assert not SC.composite(results(spark, {"a": votes}), RULES).first().complete


def test_ratings_under_veto(spark):
    high = [(90, "PASS", "POSITIVE")] * 7
    macro = [(90, "VETO" if e == "macro-cyclist" else "PASS", "POSITIVE") for e in EXPERTS]
    other = [(90, "VETO" if e == "moat-analyst" else "PASS", "POSITIVE") for e in EXPERTS]
    got = {r.run_id: r for r in SC.ratings(results(spark, {"h": high, "m": macro, "o": other}), RULES).collect()}
    assert (got["h"].allowed, got["h"].max_allocation_pct) == ("BUY", 20.0)
    assert (got["m"].allowed, got["m"].max_allocation_pct) == ("AVOID,OBSERVE", 5.0)
    assert got["o"].allowed == ""  # only BUY would be left, which a veto forbids


def test_calibration(spark):
    base = spark.createDataFrame([("a", 9, 50.0, 10.0), ("b", 9, 50.0, 0.0), ("c", 4, None, None)], "expert_id string, n long, mean double, std double")
    now = spark.createDataFrame([("t", "r", e, 70) for e in "abcd"], "ts_code string, run_id string, expert_id string, score int")
    z = SC.z_scores(now, base)
    assert {(r.expert_id, r.z, r.tag) for r in z.collect()} == {("a", 2.0, "high"), ("b", None, "no_baseline"), ("c", None, "insufficient"), ("d", None, "insufficient")}
    row = SC.calibrated_totals(z, {"a": 0.5, "b": 0.25}).first()
    assert (row.raw_total, row.calibrated_total) == (66.5, 35.0)  # unnamed roles weigh 0.1


def test_rules_are_checked(spark):
    assert SC.scoring_problems(spark, RULES).count() == 0
    bad = SC.Scoring(weights={"moat-analyst": 1.2}, tiers=(SC.Tier(10, "BUY", 5),))
    assert {r.problem for r in SC.scoring_problems(spark, bad).collect()} >= {"weight_keys", "weight_range", "weight_total", "tiers"}


# --- logs ----------------------------------------------------------------------------------


def test_durations(spark):
    at = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    rows = [("A", "sync", None, "start", at(0), 1), ("A", "sync", None, "ok", at(3), 2), ("A", "expert", "m", "start", at(4), 3), ("A", "expert", "m", "start", at(5), 4), ("A", "report", None, "ok", at(9), 5)]
    df = spark.createDataFrame(rows, "code string, phase string, expert_id string, status string, at timestamp, seq int")
    assert {(r.phase, r.status, r.duration_ms) for r in R.durations(df).collect()} == {("sync", "ok", 3000), ("expert", "timeout", 4000)}


@pytest.mark.parametrize("busy", [0, 20, 10**6])
def test_durations_in_busy_hours(spark, busy):
    """However often hours are split, starts find the same ends as in one pass over each line."""
    rng = random.Random(12)
    day = dt.datetime(2026, 1, 1)
    rows = []
    for seq in range(600):
        at = day + dt.timedelta(hours=rng.choice([0, 0, 0, 3, 30]), seconds=rng.choice([0, 1, 5, 600]), microseconds=rng.randrange(5) * 1000)
        rows.append(("AAB"[seq % 3], rng.choice(["sync", "expert"]), rng.choice([None, "m"]), rng.choice(["start", "start", "ok", "failed"]), at, seq))
    want, last = Counter(), {}
    for code, *_, at, _ in rows:
        last[code] = max(last.get(code, at), at)
    lines = {}
    for r in sorted(rows, key=lambda r: (r[4], r[5])):
        lines.setdefault((r[0], r[1], r[2] or ""), []).append(r)
    for line, events in lines.items():
        for r, after in zip(events, [*events[1:], None]):
            if r[3] == "start" and (after is None or after[3] != "start"):
                end, status = (after[4], after[3]) if after else (last[line[0]], "timeout")
                want[(*line, r[4], status, (end - r[4]) // dt.timedelta(milliseconds=1))] += 1
    df = spark.createDataFrame(rows, "code string, phase string, expert_id string, status string, at timestamp, seq int").repartition(4)
    assert Counter(tuple(r) for r in R.durations(df, busy=busy).collect()) == want


def test_rotation(spark):
    pool = spark.createDataFrame([(c, i) for i, c in enumerate("ABCD")], "ts_code string, pos int")
    last = spark.createDataFrame([("C", dt.date(2026, 6, 10)), ("D", dt.date(2026, 6, 14)), ("A", dt.date(2026, 6, 9))], "ts_code string, last_analyzed date")
    today = F.lit("2026-06-15").cast("date")
    assert R.next_in_rotation(pool, last, 2, today).first().ts_code == "A"
    assert R.next_in_rotation(pool, last, 1, today).first().ts_code == "B"


def test_sample_is_stable(spark):
    u = spark.range(500).select(F.col("id").cast("string").alias("ts_code"))
    a = [r.ts_code for r in R.seeded_sample(u, 5, "s").collect()]
    assert a == [r.ts_code for r in R.seeded_sample(u.repartition(7), 5, "s").collect()]
    assert a != [r.ts_code for r in R.seeded_sample(u, 5, "t").collect()]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    log, out, cp = (str(tmp_path / n) for n in ("log", "out", "cp"))
    schema = "at timestamp, phase string, status string, duration_ms double"

    def write(day):
        spark.createDataFrame([(dt.datetime(2026, 1, day, 5), "sync", "ok", 1.0), (dt.datetime(2026, 1, day, 6), "sync", "error", 3.0)], schema).coalesce(1).write.mode("append").parquet(log)

    write(1)
    write(2)
    frame_schema = spark.createDataFrame([], schema).schema
    RH.append_health(RH.log_stream(spark, log, frame_schema), out, cp)
    assert spark.read.parquet(out).count() == 1
    write(3)
    RH.append_health(RH.log_stream(spark, log, frame_schema), out, cp)
    rows = spark.read.parquet(out).orderBy("day").collect()
    assert [(r.total, r.ok, r.failed, r.mean_duration_ms) for r in rows] == [(2, 1, 1, 2.0)] * 2


# --- integrity -----------------------------------------------------------------------------


def test_one_altered_byte_is_found(spark, tmp_path):
    for name, text in (("a.md", "alpha"), ("b.md", "beta")):
        (tmp_path / name).write_text(text)
    listed = T.read_files(spark, str(tmp_path)).select(F.lit("A").alias("ts_code"), F.lit("r").alias("run_id"), "name", "sha256", "bytes")
    manifest = spark.createDataFrame(listed.collect(), listed.schema)
    files = lambda: T.read_files(spark, str(tmp_path)).select(F.lit("A").alias("ts_code"), F.lit("r").alias("run_id"), "name", "sha256", "bytes")
    assert I.manifest_problems(manifest, files()).count() == 0
    (tmp_path / "a.md").write_text("alphA")
    (tmp_path / "c.md").write_text("new")
    assert {(r.name, r.problem) for r in I.manifest_problems(manifest, files()).collect()} == {("a.md", "hash_differs"), ("c.md", "unexpected")}


def test_hashes(spark):
    df = spark.createDataFrame([("k", str(i), f"h{i}") for i in range(50)], "k string, name string, sha256 string")
    whole = I.set_hash(df, ["k"]).first()
    assert I.set_hash(df.orderBy(F.rand()).repartition(5), ["k"]).first() == whole and whole.files == 50
    assert I.set_hash(df.withColumn("sha256", F.when(F.col("name") == "7", "x").otherwise(F.col("sha256"))), ["k"]).first() != whole
    row = spark.createDataFrame([("a", "b", "c", "d", "e")], ", ".join(f"{c} string" for c in I.COMPONENTS)).select(I.batch_id().alias("b")).first().b
    import hashlib

    assert row == hashlib.sha256(b"a\0b\0c\0d\0e").hexdigest()[:24]


def test_hashes_that_are_added_to(spark):
    rows = [("a", str(i), f"{i:02x}") for i in range(40)] + [("b", "x", "1"), ("b", "x", "1"), ("c", None, None)]
    df = spark.createDataFrame(rows, "k string, name string, sha256 string")
    hashed = lambda f: I.multiset_hash(f, ["k"])
    whole = {tuple(r) for r in hashed(df).collect()}
    assert whole == {tuple(r) for r in hashed(df.orderBy(F.rand()).repartition(5)).collect()} and {r[2] for r in whole} == {40, 2, 1}
    words = [0] * 8
    for _, n, h in rows[:40]:
        d = hashlib.sha256(f"{n}:{h}".encode()).hexdigest()
        words = [(w + int(d[8 * i:8 * i + 8], 16)) % 2**32 for i, w in enumerate(words)]
    assert ("a", "".join(f"{w:08x}" for w in words), 40) in whole
    some = df.where("k = 'a' and name < '3' or k = 'c'")
    less = I.changed_hash(hashed(df), hashed(some.limit(0)), hashed(some), ["k"])
    rest = df.join(some.select("k", "name"), (df.k == some.k) & df.name.eqNullSafe(some.name), "left_anti")
    assert {tuple(r) for r in less.collect()} == {tuple(r) for r in hashed(rest).collect()}
    assert {tuple(r) for r in I.changed_hash(less, hashed(some), hashed(some.limit(0)), ["k"]).collect()} == whole


def test_rows_of_a_digest(spark):
    at = dt.datetime(2026, 6, 1, 23, 59)
    texts = ['---\nstock_name: "A "B""\ncomposite_score: a: 71.5\nrating: "buy"\n', 'stock_name: "x"\nstock_name: "y"\ncomposite_score: ?', "", None]
    df = spark.createDataFrame([(str(i), at, t, "n") for i, t in enumerate(texts)], "code string, modified_at timestamp, text string, name string")
    got = {r.code: (r.day, r.name, r.score, r.rating) for r in R.day_reports(df).collect()}
    assert got == {"0": ("20260601", 'A "B"', 71.5, "buy"), "1": ("20260601", "x", None, None), "2": ("20260601", None, None, None),
                   "3": ("20260601", None, None, None)}
    events = spark.createDataFrame([("c", "sync", "error", at, "m", "N"), ("c", "sync", "ok", at, "m", "N"), ("d", "sync", "crash", None, None, None)],
                                   "code string, phase string, status string, at timestamp, msg string, name string")
    assert [(r.day, r.code, r.name, r.msg) for r in R.day_failures(events).collect()] == [("20260601", "c", "N", "m")]
    assert R.day_failures(events.drop("name")).first().name is None


def test_occurrences(spark):
    df = spark.createDataFrame([("abcabc", "abc"), ("aaa", "aa"), ("x", "y"), ("x", "")], "t string, p string")
    assert [r.n for r in df.select(I.occurrences(F.col("t"), F.col("p")).alias("n")).collect()] == [2, 1, 0, None]


# --- screening -----------------------------------------------------------------------------


def test_rate_on(spark):
    rates = spark.createDataFrame([("b", dt.date(2026, 1, 1), 2.0), ("b", dt.date(2026, 1, 5), 3.0)], "rate_type string, date date, rate double")
    asked = spark.createDataFrame([("b", dt.date(2025, 12, 31)), ("b", dt.date(2026, 1, 4)), ("b", dt.date(2026, 1, 5))], "rate_type string, date date")
    assert [r.rate for r in X.rate_on(rates, asked).orderBy("date").collect()] == [None, 2.0, 3.0]


def test_candidates(spark):
    df = spark.createDataFrame([("A", dt.date(2026, 1, 1), "WATCH"), ("A", dt.date(2026, 2, 1), "CANDIDATE")], "ts_code string, trade_date date, result string")
    r = X.candidates(df).first()
    assert (r.first_screen_date, r.latest_screen_date, r.rating) == (dt.date(2026, 1, 1), dt.date(2026, 2, 1), "CANDIDATE")


class _Cluster:
    """Just enough of a session to say where it runs and what it is told."""

    def __init__(self, settings):
        self.conf = settings
        self.sparkContext = self
        self.master = "yarn"

    def getConf(self):
        return self.conf


def test_work_folders_are_shared_on_a_cluster():
    assert shared_dir(_Cluster({"spark.checkpoint.dir": "hdfs:///shared/x/"}), "t").startswith("hdfs:///shared/x/t-")
    with pytest.raises(RuntimeError):
        shared_dir(_Cluster({}), "t")
