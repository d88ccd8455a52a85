"""Divergence of sources, collocations and quality rules against brute force."""

import random
import re
from collections import Counter
from urllib.parse import quote

import numpy as np
import pytest

from ledgerlens.llm import collocations, divergence, quality

SCHEMA = "doc_id long, text string, lang string, source string, n int, f int, place string, key string, digest string, score string"
AWKWARD = ["", " ", None, "a\tb\nc  d. e", "İstanbul ÉCOLE école", "\x00 nul", "a" * 3000, "don't stop'll", "x\x1fy z", "日本語 テキスト", "..,;", "\v\f"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 1, 2, "p", "k", "d", "s") for i, t, lang, source in rows], SCHEMA)


def some_docs(seed=3):
    rng = random.Random(seed)
    vocab = ["Red", "green", "blue", "über", "la-di", "fox", "sees", "New York", "new york", "one.two", "z", "Ä"]
    rows = [(i, t, "en" if i % 2 else None, "s") for i, t in enumerate(AWKWARD)]
    rows += [(100 + i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(60))), rng.choice(["en", "d e%", None]), rng.choice(["s", "t", "", None])) for i in range(60)]
    rows += [(None, "New York new york fox", "en", "t")] * 3 + [(7, "fox sees fox sees fox sees fox", "en", "only")] + [(8, None, "xx", "empty"), (9, "fox", "xx", "other")]
    return rows


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_divergence(rows, min_docs, top):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for _, t, lang, source in rows]
    out = []
    for lang in {x[0] for x in terms}:
        mine = [x for x in terms if x[0] == lang]
        df = Counter(w for x in mine for w in set(x[2]))
        kept = {w for w, k in df.items() if k >= min_docs}
        counts = {s: Counter(w for x in mine if x[1] == s for w in x[2] if w in kept) for s in {x[1] for x in mine}}
        whole = sum(counts.values(), Counter())

        def weights(c):
            return {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p, q = {s: weights(c) for s, c in counts.items()}, weights(whole)

        def f(a, b):
            return (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in counts if o != s]
            own = [(w, f(p[s][w], q[w])) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items, last in (("pair", pairs, len(pairs)), ("term", own, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:last], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("blocks", [(2048, 128), (2, 2)])
def test_divergence(spark, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "TERM_BLOCK", blocks[0])
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", blocks[1])
    rows = some_docs()
    found = divergence.audit(frame(spark, rows), min_docs=3, top=4)
    assert sorted(map(tuple, found.collect())) == brute_divergence(rows, 3, 4)
    assert dict(found.dtypes)["value"] == "bigint" and dict(found.dtypes)["rank"] == "int"


@pytest.mark.parametrize("held", [1, 200, 8_000_000])
def test_divergence_bags(spark, monkeypatch, held):
    """Bags of any size hold every term as often as its documents; the fit has it once per document."""
    monkeypatch.setattr(divergence, "BAG_BYTES", held)
    rows = some_docs()
    docs = frame(spark, rows).coalesce(1)
    single = divergence.labelled_terms(docs).collect()
    assert len(single) == len(rows) and all(len(set(r.terms)) == len(r.terms) for r in single)
    bags = divergence.labelled_terms(docs, bags=True).collect()
    said = Counter((r.source, t) for r in bags for t in r.terms)
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for _, t, lang, source in rows]
    assert said == Counter((s, quote(lang, safe="") + "\x1f" + w) for lang, s, ws in words for w in ws)
    if held > 1000:
        assert len(bags) == len({(lang, s) for lang, s, ws in words if ws})
    if held == 200:
        assert sorted(map(tuple, divergence.audit(docs, min_docs=3, top=4).collect())) == brute_divergence(rows, 3, 4)


def test_divergence_without_terms(spark):
    rows = [(1, "a b", "en", "s"), (2, "c", "en", "t"), (3, None, "de", "s")]
    assert sorted(map(tuple, divergence.audit(frame(spark, rows)).collect())) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    assert divergence.audit(frame(spark, []).limit(0)).collect() == []


def brute_phrases(rows, least, first, cover=100):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            ws = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang or "und"] += len(ws)
            f.update((lang or "und", ws[i : i + k]) for k in range(1, 6) for i in range(len(ws) - k + 1))
    cands = {(lang, g): a for (lang, g), a in f.items() if len(g) > 1 and a >= least}
    out = {}
    for (lang, g), a in cands.items():
        longer = [b for (m, h), b in cands.items() if m == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
        if any(100 * b >= cover * a for b in longer):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), " ".join(g), a, left, right, n[lang], score))
    return sorted((lang, rank, *x[3:]) for lang, xs in out.items() for rank, x in enumerate(sorted(xs)[:first], 1))


@pytest.mark.parametrize(("least", "hot", "cover", "held"), [(5, 10**9, 100, 10**6), (5, 8, 100, 50), (3, 0, 60, 1), (2, 20, 100, 10**6)])
def test_phrases(spark, monkeypatch, least, hot, cover, held):
    for name in ("HELD_WORDS", "HELD_PAIRS", "HELD_SUFFIXES"):
        monkeypatch.setattr(collocations, name, held)
    rows = some_docs() + [(500, "one two three four five six, " * 30, "en", "s")]
    found = collocations.mine_phrases(frame(spark, rows), least, first=50, hot=hot, bucket_rows=40, cover=cover).collect()
    assert sorted(map(tuple, found)) == brute_phrases(rows, least, 50, cover)


def test_phrases_of_nothing(spark):
    assert collocations.mine_phrases(frame(spark, []).limit(0)).collect() == []
    assert collocations.mine_phrases(frame(spark, [(1, None, None, None), (2, "a b", "en", "s")])).collect() == []


def test_quicksort_counts():
    rng = np.random.default_rng(5)
    words = rng.integers(1, 5, (3000, 5)).astype(np.uint64)
    words[np.arange(5) >= rng.integers(1, 6, 3000)[:, None]] = 0
    n = rng.integers(1, 4, 3000)
    expected = Counter()
    for row, k in zip(words.tolist(), n.tolist(), strict=True):
        for d in range(1, 6):
            if row[d - 1]:
                expected[tuple(row[:d])] += k
    got = {tuple(words[i, :d].tolist()): int(t) for d, one, total in collocations.sorted_partitions(words, n, 60, 5) for i, t in zip(one, total, strict=True)}
    assert got == {k: v for k, v in expected.items() if v >= 60}


def brute_counts(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {i + k for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = len(lines) - len(set(lines))
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(ws) < 50 or 100 * len(covered) > 50 * len(ws))


def quality_rows(spark):
    rng = random.Random(9)
    good = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(rng.randrange(60, 200))) for _ in range(80)]
    bad = [" ".join(w + rng.choice("#*$") * 3 for w in t.split()) for t in good[:12]]
    rows = [(i, t, "en", "s") for i, t in enumerate(good + bad)]
    rows += [(200 + i, t, "en", "s") for i, t in enumerate([*AWKWARD, "a b c " * 60, "line of words\n" * 30, "Ä ÖÜ é " * 20, good[3], "\x85 \xa0x " * 40])]
    return rows + [(None, good[5], None, None), (3, good[3], "en", "s")]


def test_quality(spark):
    rows = quality_rows(spark)
    labels = spark.createDataFrame([(i, int(i < 80), None) for i in range(92)] + [(3, None, 1), (999, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    found = quality.assess(frame(spark, rows), labels, tree_rows=64).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted((str(r.doc_id), *(r[c] for c in names)) for r in found) == sorted((str(i), *brute_counts(t)) for i, t, _, _ in rows)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].kept for i in range(80)) and not any(by_id[i].kept for i in range(80, 92)) and by_id[None].kept
    assert all(not r.kept for r in found if r.base_failed) and len({r.score for r in found if r.doc_id == 3}) == 1
    again = quality.assess(frame(spark, rows).repartition(7), labels.repartition(3), tree_rows=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_quality_without_labels(spark):
    docs = frame(spark, quality_rows(spark))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept != r.base_failed and r.score == 0 for r in quality.assess(docs, none).collect())
    only_good = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    assert all(r.kept for r in quality.assess(docs, only_good).collect() if r.doc_id in range(40))
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.assess(docs, one).collect()} == {0.0}
    assert quality.assess(docs.limit(0), only_good).collect() == []


def test_repeated_words_of_many():
    ids = np.concatenate([np.arange(1 << 20, (1 << 20) + 5), np.arange(1 << 20, (1 << 20) + 5), [1, 2, 1, 2]])
    assert quality.repeated_words(ids, np.zeros(len(ids), int), 1).tolist() == [10]


def test_paths_of_a_split():
    forest = quality.Forest(np.array([[0.0]] * 63 + [[1.0]]), trees=50, tree_rows=64)
    low, high = forest.score(np.array([[0.0], [1.0]]))
    assert high > 0.8 > 0.6 > low
