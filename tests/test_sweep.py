"""Many parts of a text counted in one sweep, against Python's own count."""

import hashlib
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.bindings import archives
from ledgerlens.operators import integrity as I
from ledgerlens.operators import sweep


def asked(parts):
    return [(len(p), sweep.mark(p), hashlib.sha256(p.encode()).hexdigest()) for p in parts]


@settings(max_examples=200, deadline=None)
@given(st.text("ab\u4e2d\U0001f642", max_size=60), st.lists(st.text("ab\u4e2d\U0001f642", min_size=1, max_size=6), max_size=8))
def test_counts_are_those_of_str(text, parts):
    assert sweep.count_parts(text, asked(parts)) == [text.count(p) for p in parts]


def test_counts_of_long_and_repetitive_texts():
    text = "-" * 200_000 + "end"
    parts = ["-", "--", "-" * 70_000, "-" * 200_001, "end", "-end", "--" * 60_000 + "e"]
    assert sweep.count_parts(text, asked(parts)) == [text.count(p) for p in parts]
    assert sweep.count_parts("", asked(parts)) == [0] * len(parts)


@settings(max_examples=200, deadline=None)
@given(st.text("ab\u4e2d\U0010ffff", max_size=40), st.integers(1, 40), st.lists(st.tuples(st.integers(0, 200), st.integers(1, 200)), max_size=8))
def test_counts_by_heads_are_those_of_str(piece, repeats, cuts):
    text = (piece * repeats)[:400] + "end"
    parts = [p for i, k in cuts for p in (text[i : i + k], text[i : i + k] + "x") if p]
    assert sweep.count_parts(text, asked(parts), [sweep.head(p) for p in parts]) == [text.count(p) for p in parts]


def test_heads_of_repetitive_texts_leave_few_digests(monkeypatch):
    """Many places of a head are told apart by the windows' hashes: a digest only for what is then a hit."""
    text = "-" * 50_000 + "end" + "-" * 50_000
    parts = ["-" * 40, "-" * 30_000, "-" * 30_000 + "x" + "-" * 99, "-" * 40_000 + "e", "nothing of this stands in the text at all"]
    taken, sha = [], hashlib.sha256
    known, heads = asked(parts), [sweep.head(p) for p in parts]
    monkeypatch.setattr(sweep.hashlib, "sha256", lambda b: taken.append(len(b)) or sha(b))
    assert sweep.count_parts(text, known, heads) == [text.count(p) for p in parts] == [2500, 2, 0, 1, 0]
    assert len(taken) == 2503


def sample():
    rng = random.Random(3)
    docs, parts = [], []
    for k in range(30):
        own = ["".join(rng.choice("xyz \n") for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(0, 12))]
        body = "".join(rng.choice(own or ["q"]) + rng.choice(["", "<!-- " + rng.choice(own or ["q"]) + "\n-->"]) for _ in range(12))
        docs.append((k, None if k == 4 else body, 1))
        parts += [(k, f"e{i}", p, k) for i, p in enumerate(own)]
    docs.append((7, "x", 2))  # a second document of the same key
    return docs, [*parts, (7, "none", None, 0), (99, "lost", "x", 0)]


def test_counted(spark):
    docs, parts = sample()
    d, s = spark.createDataFrame(docs, "id long, text string, times int"), spark.createDataFrame(parts, "id long, expert string, part string, mark long")
    plain = [(re.sub(r"(?s)<!--.*?-->", "", t), i) for i, t, _ in docs if t is not None]
    want = Counter((i, e, p, t.count(p)) for t, j in plain for i, e, p, _ in parts if i == j and p)
    for at_most in (3, 10_000):
        visible = d.selectExpr("id", r"regexp_replace(text, '(?s)<!--.*?-->', '') AS doc")
        got = Counter((r.id, r.expert, r.part, r.times) for r in sweep.counted(visible, s, ["id"], "doc", "part", at_most).collect())
        assert got == want
    out = I.embedded_once(d, s, ["id"])
    assert Counter((r.id, r.expert, r.part, r.times) for r in out.collect()) == Counter({k: n for k, n in want.items() if k[3] != 1})
    assert I.embedded_once(d.limit(0), s, ["id"]).count() == 0 and I.embedded_once(d, s.limit(0), ["id"]).count() == 0


def test_carried_columns_come_without_the_join(spark):
    docs = [(1, "one two two"), (2, "one"), (3, None), (4, "x")]
    parts = [(1, "a", "one"), (1, "b", "two"), (1, "b", "two"), (1, None, "two"), (1, "c", ""), (1, "d", None), (2, "a", "two"), (3, "a", "one"), (4, "e", ""), (9, "a", "one")]
    d, s = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(parts, "id long, expert string, part string")
    want = Counter({(1, "a", 1): 1, (1, "b", 2): 2, (1, None, 2): 1, (2, "a", 0): 1})
    for at_most in (2, 10_000):
        out = sweep.counted(d, s, ["id"], "text", "part", at_most, carry=["expert"])
        assert out.columns == ["id", "expert", "times"] and Counter(map(tuple, out.collect())) == want
    assert Counter(map(tuple, sweep.counted(d, s, ["id"], "text", "part", carry=[]).collect())) == Counter({(1, 1): 1, (1, 2): 3, (2, 0): 1})


def test_drafts_are_neither_broadcast_nor_made_before_the_exchange(spark):
    """Only the few documents with very many parts are broadcast, and no text is made for a filter of narrow rows."""
    plan = archives.embedded_once(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and "(__loads#" in plan.split("BroadcastExchange")[1]
    filters = re.findall(r"DataFilters: \[(.*?)\], Format", plan, re.S)
    assert filters and all(re.fullmatch(r"isnotnull\(run_id#\d+\)", f) for f in filters), filters
