"""Operators of the llm part against brute force, on small tables with awkward rows."""

import hashlib
import json
import math
import random
import tracemalloc
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
import tools_check
from ledgerlens.llm import (backoff, decontaminate, digests, elias_fano, graphs, jaccard, language, packing, queries, substrings,
                            token_counts, token_files, token_ids, tool_calls)

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, node int, k int, tail int"
AWKWARD = ["", " ", "  two  blanks ", "a\tb\nc  d", "x" * 3000, "<|endoftext|> in <|endoftext|>text", "don't stop'll", "日本語 テキスト 𝟘", "A▁b ▁", "\x00 nul",
           "é" * 40 + " ÀÉ", "1 2 3", "\n\n \n", "a  <|endoftext|>  b ", "İstanbul ǅ ªº", " x y᠎ z", "end ", "ẞ ", "🙂🙂 ok"]


def words(seed, n, vocab=400):
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(vocab)) + rng.choice("xyz") for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None, "b", 1, 2, 3) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward texts, nulls, repeated rows, a long text, near copies and a shared passage."""
    rows = [(i, t, "en") for i, t in enumerate(AWKWARD)]
    rows += [(50, None, None), (None, "no id here", "en"), (None, None, "de"), (51, "same row", "en"), (51, "same row", "en"), (51, "other text", "en")]
    base, passage = words(1, 120), words(2, 60)
    rows += [(60, base, "en"), (61, base, "de"), (62, base.replace("a", "A"), "en"), (63, base + " more", "en"), (64, words(3, 4000, 9000), "en")]
    rows += [(70 + i, words(100 + i, 40) + " " + passage + " " + words(200 + i, 30), "en") for i in range(4)]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


# counting ------------------------------------------------------------------------------------------------

@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" ▁aeinrst.\n'é", max_size=60)))
def test_counts_are_the_librarys(text):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert token_counts.counter(PIECES).count(text) == len(model.encode(text))


def test_token_counts(docs, empty):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter((i, len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 100) for i, t in collected(docs))
    got = Counter(tuple(r) for r in token_counts.count_tokens(docs, PIECES, 100).collect())
    assert got == want
    assert token_counts.count_tokens(empty, PIECES).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\t'stx1.é<|endoftext|>᠎ ", max_size=60)))
def test_ids_are_the_librarys(text):
    whole = Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(token_ids.words(BYTE_BPE).ids(text), "<u4").tolist() == whole


# files ---------------------------------------------------------------------------------------------------

@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    held = elias_fano.Sequence(elias_fano.encode(np.array(values, np.uint64)))
    assert held.values().tolist() == values and [held.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(100, 1500, 5000))
    assert len(elias_fano.encode(ends)) < 0.25 * 8 * len(ends)


@pytest.mark.parametrize("shard_ids", [1, 500, 1 << 20])
def test_token_files(spark, docs, empty, tmp_path, shard_ids):
    token_files.write(docs, BYTE_BPE, f"{tmp_path}/a", 0, shard_ids)
    library = Tokenizer.from_file(BYTE_BPE)
    at, want = 0, []
    for i, t in sorted(collected(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.read(spark, f"{tmp_path}/a").collect()), key=lambda r: r[1]) == want
    token_files.write(empty, BYTE_BPE, f"{tmp_path}/b")
    assert token_files.read(spark, f"{tmp_path}/b").count() == 0


def test_range_keys_of_token_files_hold_no_whole_text(spark, docs):
    rows = token_files.ordered(docs)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    keys = plan[plan.index("rangepartitioning("):].split("\n")[0]
    assert "substring(text" in keys and ", text#" not in keys
    got = [(r.doc_id, r.text) for r in rows.collect()]
    assert got == sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())) and len(got) == docs.count()


# packing -------------------------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_supersteps_are_best_fit(counts):
    """Run by run the packing is what placing one piece after the other into the smallest gap gives."""
    gaps: list[int] = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [g for g in gaps if g >= length]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - length)
            else:
                gaps.append(32 - length)
    filled = Counter()
    for length, _, n, first, per, offset in packing.supersteps(counts, 32):
        for r in range(n):
            at = first + r // per
            assert filled[at] == offset + r % per * length
            filled[at] += length
    assert Counter(32 - x for x in filled.values()) == Counter(gaps)


def test_packing(docs, empty):
    library = Tokenizer.from_file(BYTE_BPE)
    got = packing.pack(docs, BYTE_BPE, 256).collect()
    want = Counter()
    for i, t in collected(docs):
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4")
        at = len(ids) % 256 or min(len(ids), 256)
        cuts = [0, *range(at, len(ids) + 1, 256)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= 1.1 * math.ceil(sum(r.length for r in got) / 256) + 1
    assert packing.pack(empty, BYTE_BPE).count() == 0


# leaks ---------------------------------------------------------------------------------------------------

def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, 14))
def test_leaks_are_those_within_the_budget(seed, edits):
    rng = random.Random(seed)
    item = words(seed, 18)
    changed = list(item)
    for _ in range(edits):
        k, kind = rng.randrange(len(changed)), rng.randrange(3)
        changed[k:k + (kind != 0)] = [] if kind == 2 else ["q"]
    text = words(seed + 1, 25) + " " + "".join(changed) + " " + words(seed + 2, 25)
    index = decontaminate.Index([(7, item)])
    want = edit_distance_inside(decontaminate.normal(item), decontaminate.normal(text)) <= index.items[0].edits
    found = index.leaks(text)
    assert bool(found) == want
    for _, a, b, cost in found:
        assert cost == edit_distance_inside(decontaminate.normal(item), decontaminate.normal(text)[a:b])


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 100_000), st.sampled_from([8, 9, 10, 11, 13, 15, 16, 30, 31, 33]), st.integers(0, 4))
def test_leaks_of_short_items_within_the_budget(seed, size, edits):
    rng = random.Random(seed)
    item = "".join(rng.choice("abcd") for _ in range(size))
    changed = list(item)
    for _ in range(edits):
        k = rng.randrange(len(changed))
        changed[k:k + 1] = rng.choice([[], ["a"], [changed[k], "b"]])
        changed = changed or ["d"]
    text = "".join(rng.choice("abcd") for _ in range(rng.randrange(50))) + "".join(changed) + "".join(rng.choice("abcd") for _ in range(rng.randrange(50)))
    found = decontaminate.Index([(7, item)]).leaks(text)
    assert bool(found) == (edit_distance_inside(item, text) <= size // 10)
    assert all(cost == edit_distance_inside(item, text[a:b]) for _, a, b, cost in found)


def test_leaks_in_repetitive_and_very_long_texts(monkeypatch):
    item = "-" * 400
    index = decontaminate.Index([(1, item)])
    whole = index.leaks("-" * 20_000)
    assert whole and all(b - a == 400 and cost == 0 for _, a, b, cost in whole)
    monkeypatch.setattr(decontaminate, "STRETCH", 1_000)  # many stretches count the same
    assert index.leaks("-" * 20_000) == whole
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(20_000)).strip()
    long = decontaminate.normal(long)
    spoilt = "".join("z" if rng.random() < 0.03 else c for c in long)
    [(item_id, a, b, cost)] = decontaminate.Index([(2, long)]).leaks("q" * 5_000 + spoilt + "r" * 300)
    assert (item_id, a, b) == (2, 5_000, 5_000 + len(long)) and 0 < cost <= sum(x != y for x, y in zip(long, spoilt, strict=True))


def test_find_leaks(spark, docs, empty):
    items = spark.createDataFrame([(1, words(2, 60).upper(), "x"), (2, words(77, 30), "x"), (3, None, "x"), (4, "", "x"), (5, "1 2", "x"), (1, words(2, 60), "x")],
                                  "item_id long, text string, leak string")
    for block_chars in (100, 10_000):  # a large benchmark takes several passes
        got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items, block_chars).collect()}
        assert got == {(70, 1), (71, 1), (72, 1), (73, 1), (11, 5)}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 5
    assert decontaminate.find_leaks(empty, items).count() == 0 and decontaminate.find_leaks(docs, items.limit(0)).count() == 0


# scores --------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff(docs, empty, order):
    def split(t):
        return t.encode().lower().split()

    rows = [(i, split(t)) for i, t in collected(docs)]
    total = Counter(tuple(w[k:k + n]) for _, w in rows for n in range(1, order + 1) for k in range(len(w) - n + 1))
    size = sum(len(w) for _, w in rows)
    want = []
    for i, w in rows:
        own = Counter(tuple(w[k:k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1))
        value = 0.0
        for k in range(len(w)):
            for n in range(min(order, k + 1), 0, -1):
                gram = tuple(w[k - n + 1:k + 1])
                c = total[gram] - own[gram]
                if n == 1:
                    value += math.log(max(c, 0.5) / max(1, size - len(w)))
                elif c > 0:
                    value += math.log(c / (total[gram[:-1]] - own[gram[:-1]]))
                    break
                else:
                    value += math.log(0.4)
        want.append((i, len(w), round(value, 6)))
    got = [(r.doc_id, r.n_words, round(r.log_score, 6)) for r in backoff.score(docs, order, block_bytes=2000, bucket_bytes=3000).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert backoff.score(empty).count() == 0


def test_backoff_trigrams_score_with_three_words(spark):
    """Known word pairs in sequences that no other document has back off once more than with two words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by = {r.doc_id: r.n_backoffs for r in queries.QUERIES["op5_backoff_trigrams"](spark, SF).collect()}
    two = {r.doc_id: r.n_backoffs for r in queries.op5_backoff(spark, SF).collect()}
    assert set(by) == set(two) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(by[i] >= two[i] for i in by) and sum(by.values()) > sum(two.values())


# digests -------------------------------------------------------------------------------------------------

def plain_digest(text):
    """The fingerprint by its definition: one loop over windows and triplets, quartiles from the sorted counts."""
    data = text.encode()
    counts = [0] * 256
    for end in range(4, len(data)):
        for i, j, salt in ((1, 2, 3), (1, 3, 5), (2, 3, 7), (2, 4, 11), (1, 4, 13), (3, 4, 17)):
            code = data[end] + data[end - i] * 256 + data[end - j] * 65536 + salt * 16777216
            counts[code * 0x9E3779B1 % 2**32 // 2**24] += 1
    low, middle, high = (sorted(counts)[k] for k in (63, 127, 191))
    quartiles = [0 if c <= low else 1 if c <= middle else 2 if c <= high else 3 for c in counts]
    packed = "".join(f"{a * 64 + b * 16 + c * 4 + d:02x}" for a, b, c, d in zip(*(quartiles[k::4] for k in range(4)), strict=True))
    return f"{min(255, round(8 * math.log2(1 + len(data)))):02x}" + packed, quartiles, min(255, round(8 * math.log2(1 + len(data))))


def plain_likeness(a, b):
    steps = sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(a[1], b[1], strict=True))
    return 1 - (steps + min(16, abs(a[2] - b[2]))) / (6 * 256 + 16)


@pytest.mark.parametrize("ranges", [1, 7, 40, None])
def test_digests_by_definition(docs, ranges):
    """Every row, repeated ones as often as they stand there, against plain loops, whatever the number of ranges."""
    rows = sorted(collected(docs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = Counter()
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        changed = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        own, new, other = plain_digest(t), plain_digest(changed), plain_digest(after)
        want[i, len(t), hashlib.sha256(changed.encode()).hexdigest(), own[0], new[0], round(plain_likeness(own, new), 9), round(plain_likeness(own, other), 9)] += 1
    got = digests.fingerprint_edits(docs, ranges).collect()
    assert Counter((*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


@pytest.mark.parametrize("ranges", [1, 3])
def test_digests(docs, empty, ranges):
    rows = sorted(collected(docs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in digests.fingerprint_edits(docs, ranges).collect()}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        changed = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        r = got[i, len(t), hashlib.sha256(changed.encode()).hexdigest()]
        own, new, other = digests.Digest(t), digests.Digest(changed), digests.Digest(after)
        assert (r.fingerprint, r.edited_fingerprint) == (str(own), str(new))
        assert (r.near_edited, r.near_next) == (own.likeness(new), own.likeness(other))
        assert 0 <= r.near_next <= 1 and own.likeness(own) == 1
    assert digests.fingerprint_edits(empty).count() == 0


def test_digests_without_ids(spark):
    got = digests.fingerprint_edits(spark.createDataFrame([(None, "a" * 50), (None, "b" * 50)], "doc_id long, text string")).collect()
    assert len(got) == 2


def test_counts_of_long_texts_do_not_depend_on_stretches():
    data = words(5, 30_000).encode()
    slow = np.zeros(digests.BUCKETS, np.int64)
    for at in range(0, len(data) - 4, 1000):
        slow += digests.bucket_counts(data[at:min(at + 1004, len(data))])
    assert (slow == digests.bucket_counts(data)).all()


# language ------------------------------------------------------------------------------------------------

def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_language_of_awkward_rows(docs, empty):
    rows = language.predict(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for (_, t), r in zip(collected(docs), rows, strict=True):
        by[t] = r
    for t in ("", " ", "1 2 3", "\n\n \n"):
        assert by[t].lang_pred == "und" and by[t].rejected
    assert all(r.lang_pred in ("en", "de", "und") for r in rows)
    assert language.predict(empty).count() == 0


def test_copies_of_a_text_take_one_place_in_the_sample(spark):
    """However often some or all texts are copied, as many distinct ones are learned from, each with the same weight."""
    rows = [(i, words(i, 20), "en" if i % 3 else "es") for i in range(90)]
    model = language.learn(frame(spark, rows), sample_docs=10)
    assert len(model) == 2
    assert language.learn(frame(spark, rows * 12), sample_docs=10) == model
    assert language.learn(frame(spark, rows + rows[:45] * 3), sample_docs=10) == model


# similarity ----------------------------------------------------------------------------------------------

def brute_classes(rows, size, threshold):
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, (_, x)), (b, (_, y)) in combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= threshold * len(x | y):
            root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(sets):
        groups.setdefault(find(k), []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return Counter((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def test_jaccard(docs, empty):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect())
    assert got == brute_classes(collected(docs), 4, 85)
    assert jaccard.classes(empty).count() == 0


@pytest.mark.parametrize("seed,threshold", [(1, 85), (2, 80)])
def test_jaccard_of_groups_of_near_copies(spark, seed, threshold):
    """Copies of a few bases with one to eight words changed, and a passage that all share: every link counts."""
    rng, rows, passage = random.Random(seed), [], words(9, 30)
    for g in range(4):
        base = words(seed * 100 + g, rng.randrange(60, 160)).split()
        for _ in range(30):
            w = list(base)
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = "new" + str(rng.randrange(5000))
            rows.append((len(rows), " ".join(w + (passage.split() if rng.random() < 0.5 else [])), "en"))
    docs = frame(spark, rows)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs, 4, threshold).collect())
    assert got == brute_classes(collected(docs), 4, threshold)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {(r.node, r.root) for r in graphs.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(90, 90), (95, 90), (100, 90)}


# passages ------------------------------------------------------------------------------------------------

def test_repeated_passages_go(docs, empty):
    got = substrings.deduplicate(docs, block_bytes=3000, bucket_bytes=3000).collect()
    assert len(got) == docs.count() and substrings.deduplicate(empty).count() == 0
    left, passage = {r.doc_id: r for r in got if r.doc_id}, words(2, 60).split()
    assert left[70].text.count(" ".join(passage)) == 1
    for i in (71, 72, 73):
        own = set(left[i].text.split())
        assert sum(w in own for w in passage) < 15
        assert words(100 + i - 70, 40).split()[:36] == left[i].text.split()[:36]
    texts = dict(collected(docs))
    for r in got:
        assert (r.text is None) == (r.doc_id == 50 or r.doc_id is None and r.lang == "de")
        if not r.removed_spans and r.doc_id in (60, 64):
            assert r.text == texts[r.doc_id]
    assert left[60].text and len(left[61].text) < 0.25 * len(left[60].text)  # an exact copy goes but for its end
    assert left[50].k == 2 and left[50].block == "b"


@settings(max_examples=40, deadline=None)
@given(st.text(min_size=0, max_size=400), st.integers(0, 400))
def test_what_goes_is_whole_characters(text, seed):
    data = (text * 3).encode()
    rng = random.Random(seed)
    ends = sorted(rng.sample(range(len(data) + 1), min(6, len(data) + 1)))
    spans = substrings.united(data, np.array(ends[:-1:2]), np.array(ends[1::2]))
    substrings.rest(data, spans)  # decodes


def test_a_block_of_chunks_is_small():
    texts = [words(i, 2000) for i in range(substrings.BLOCK_BYTES // len(words(0, 2000).encode()))]
    tracemalloc.start()
    substrings.block_chunks(texts, substrings.LEAST)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24_000_000


def test_cuts_move_with_insertions():
    a = words(1, 300).encode()
    b = words(2, 7).encode() + a
    shift = len(b) - len(a)
    assert {x for x in substrings.cuts(a)[1:] if x > 32} <= {x - shift for x in substrings.cuts(b)}


# calls ---------------------------------------------------------------------------------------------------

CALLS = ("conv_id long, turn long, role string, text string, tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string, "
         "status string")


def test_calls_are_linked_ordered_and_validated(spark):
    ref = lambda i: json.dumps({"query": {"$ref": i}})
    rows = [(1, 0, "assistant", None, [("a", "search", '{"query": "x", "limit": 1.0}'), ("b", "search", ref("c"))], None),
            (1, 1, "tool", "first", None, "a"), (1, 2, "assistant", None, [("c", "count", '{"unit":"line","text":"é"}'), ("c", "count", "{}")], None),
            (1, 3, "tool", "third", None, "c"), (1, 3, "tool", "second", None, "b"), (1, 4, "tool", "again", None, "a"), (1, 4, "tool", "who", None, "z"),
            (2, 0, "assistant", None, [("p", "search", ref("q")), ("q", "search", ref("p"))], None), (2, 1, "tool", "x", None, "p"), (2, 1, "tool", "y", None, "q"),
            (None, 0, "assistant", None, [("a", "none", None)], None), (3, 0, "tool", None, None, None), (4, None, "user", "hi", None, None), (5, 0, "assistant", "", [], None)]
    out = tool_calls.link(spark.createDataFrame([(*r, "clash") for r in rows], CALLS), queries.SCHEMAS).collect()
    got = {(r.conv_id, r.kind, r.call_id, r.turn, r.nth): r for r in out}
    assert len(out) == 15
    one = [r for r in out if r.conv_id == 1 and r.status == "ok"]
    place = {(r.kind[0], r.call_id): (r.behind.turn, r.behind.nth, r.behind["from"], r.behind.steps) for r in one}
    assert set(place) == {(k, i) for k in "cr" for i in "abc"}
    assert all(place["c", i] < place["r", i] for i in "abc") and place["r", "c"] < place["c", "b"]
    assert [r.status for r in out if r.conv_id == 2] == ["cyclic"] * 4
    assert got[1, "call", "c", 2, 1].status == "duplicate" and got[1, "result", "z", 4, -1].status == "orphan"
    assert got[1, "result", "a", 4, -1].status == "duplicate" and got[3, "result", None, 0, -1].status == "orphan"
    assert json.loads(got[1, "call", "a", 0, 0].json) == {"arguments": {"limit": 1, "query": "x"}, "id": "a", "kind": "call", "name": "search",
                                                          "status": "ok", "valid": True}
    assert got[1, "call", "c", 2, 0].problems == ["$.unit: not one of the values"] and "é" in got[1, "call", "c", 2, 0].json
    assert tool_calls.link(spark.createDataFrame([], CALLS), queries.SCHEMAS).count() == 0


def brute_order(order, needs):
    """Members of cycles; and for all nodes (largest place among what it rests on, longest way from there), cycles left out."""
    def reached(edges):
        out = {x: set(edges.get(x, ())) for x in order}
        while any(any(not out[z] <= out[x] for z in list(out[x])) for x in out):
            out = {x: set().union(out[x], *(out[z] for z in out[x])) for x in out}
        return out

    cyclic = {x for x, below in reached(needs).items() if x in below}
    open_needs = {x: {y for y in ys if y not in cyclic} for x, ys in needs.items() if x not in cyclic}
    below, top = reached(open_needs), {}
    for x in order:
        top[x] = max([x, *below[x]], key=order.index)

    def steps(x):
        return max((1 + steps(y) for y in open_needs.get(x, ()) if top[y] == top[x]), default=0)
    return cyclic, {x: (top[x], steps(x)) for x in order}


def test_order_and_cycles_of_random_graphs(spark):
    """Forward, backward, chained and tangled needs, cycles within cycles and nodes behind them, against brute force."""
    rng, rows, wanted = random.Random(4), [], {}
    for conv in range(40):
        n = rng.randrange(2, 14)
        order = [f"n{k}" for k in rng.sample(range(100), n)]
        needs = {}
        for _ in range(rng.randrange(0, 2 * n) if conv % 3 else rng.randrange(0, n)):
            x, y = rng.sample(order, 2)
            if conv % 4 or order.index(x) > order.index(y):
                needs.setdefault(x, set()).add(y)
        if conv == 5:
            order = [f"n{k}" for k in range(12)]
            needs = {order[k]: {order[k + 1]} for k in range(11)}  # a chain against the order
        wanted[conv] = (order, *brute_order(order, needs))
        rows.append((conv, order, needs))
    nodes = spark.createDataFrame([(c, x, k // 3, k % 3) for c, order, _ in rows for k, x in enumerate(order)], "conv_id long, node string, turn long, nth int")
    edges = spark.createDataFrame([(c, y, x) for c, _, needs in rows for x, ys in needs.items() for y in ys] * 2, "conv_id long, before string, after string")
    got = tool_calls.ordered(nodes, edges).collect()
    assert len(got) == sum(len(order) for order, _, _ in wanted.values())
    for r in got:
        order, cyclic, places = wanted[r.conv_id]
        assert r.cyclic == (r.node in cyclic), (r, order)
        assert (r.behind["from"], r.behind.steps) == places[r.node], (r, order)
        assert 3 * r.behind.turn + r.behind.nth == order.index(r.behind["from"])


def test_arguments():
    assert tool_calls.check("search", '{"query":"a","query":"b"}', queries.SCHEMAS)[1] == ["$: no JSON"]
    assert tool_calls.check("search", '{"query":NaN}', queries.SCHEMAS)[0] is None
    for half in ('{"query":"\\ud800"}', '{"query":"a","\\udc00":1}', '{"query":{"$ref":"\\ud800"}}'):
        assert tool_calls.check("search", half, queries.SCHEMAS) == (None, ["$: no JSON"], [])
    assert tool_calls.check("search", '{"query":"\\ud83d\\ude42"}', queries.SCHEMAS) == ('{"query":"🙂"}', [], [])
    assert tool_calls.check("none", "{}", queries.SCHEMAS)[1] == ["$: unknown tool"]
    assert tool_calls.check("join", '{"parts":["a",true]}', queries.SCHEMAS)[1] == ["$.parts[1]: not of type string"]
    assert tool_calls.canonical({"b": 1, "a": [None, "é"]}) == '{"a":[null,"é"],"b":1}'


def test_derived_calls_keep_their_order(spark):
    rows = queries.op2_tool_calls(spark, SF).collect()
    place = {(r.conv_id, r.kind, r.call_id): (r.behind_turn, r.behind_nth, r.behind_from, r.steps) for r in rows if r.status in ("ok", "unanswered")}
    linked = [r for r in rows if r.status == "ok" and r.kind == "call"]
    assert linked and all(place[r.conv_id, "call", r.call_id] < place[r.conv_id, "result", r.call_id] for r in linked)
    for r in rows:
        for need in tool_calls.references(json.loads(r.json).get("arguments")):
            before = place.get((r.conv_id, "result", need))
            assert r.status == "duplicate" or before is None or before < place[r.conv_id, "call", r.call_id]


# queries and pipeline ------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    res = tools_check.connect(SF).execute(queries.ORACLE[name])
    assert tools_check.compare([tuple(r) for r in df.collect()], df.columns, res.fetchall(), [d[0] for d in res.description]) == ""


def test_pipeline(spark):
    docs = queries.documents(spark, SF)
    given_rows = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert docs.columns == given_rows.columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    texts = {r.doc_id: r.text for r in given_rows.collect()}
    classes = brute_classes(sorted((i, t) for i, t in kept["language"].items()), 5, 80)
    assert set(kept["near_copies"]) == {i for i, _, c in classes if i == c}
    assert len(kept["language"]) > 0.97 * len(texts)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for t in kept["benchmark"].values():
        assert not any(decontaminate.normal(x) in decontaminate.normal(t) for x in items)
    pieces = corpus_pipeline.packed(spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == set(kept["benchmark"])


def test_near_copies_keep_every_text(spark):
    """Ids that several texts share, copies under one id and under none, against brute force; extra columns may have any name."""
    rng = random.Random(11)
    bases = [words(500 + g, 70) for g in range(6)]
    rows = [(5, bases[0]), (9, bases[0]), (9, bases[1]), (11, bases[2]), (11, bases[2]), (None, bases[3]), (None, bases[3] + " "), (None, bases[0]),
            (None, None), (3, ""), (3, " "), (3, ""), (20, bases[4]), (20, bases[4] + " tail"), (21, bases[5]), (21, bases[4])]
    rows += [(rng.randrange(30, 45), bases[rng.randrange(6)] + rng.choice(["", " more", " \n", "".join(" " + words(rng.randrange(9), 40))])) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "en", k, k, k, [k]) for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, gone_id int, node int, row int, stays array<int>")
    out = corpus_pipeline.one_of_near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    shingles = lambda t: frozenset(tuple(w[k:k + 5]) for w in [(t or "").encode().lower().split()] for k in range(max(1, len(w) - 4)) if w)
    groups = []
    for i, t in rows:
        near = [g for g in groups if any(100 * len(shingles(t) & shingles(u)) >= 80 * len(shingles(t) | shingles(u)) for _, u in g)] if shingles(t) else []
        groups = [g for g in groups if g not in near] + [[(i, t), *(x for g in near for x in g)]]
    assert sum(got.values()) == len(groups)
    for group in groups:
        least = min((i is None, i or 0) for i, _ in group)
        assert sum(got[x] for x in set(group)) == 1 or not shingles(group[0][1])
        assert any(got[x] and (x[0] is None, x[0] or 0) == least for x in group)


def test_stages_take_awkward_rows(spark, docs, empty):
    for rows in (docs, empty):
        out = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SF)
            assert out.columns == rows.columns
        assert out.count() <= rows.count()
        assert corpus_pipeline.STAGES[-1][1](spark, out, SF).count() >= 0


def test_ids_part_words_like_the_library():
    rng = random.Random(7)
    marks = ["a", "Th", "é", "ɐ", "'s", "_", ".", ",", "!)", "\n", "\n\n", "\r\n", "\t", " ", "  ", "1", "中", "<|endoftext|>", "́", "᠎", "\x1c", "\x85"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for _ in range(4000):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(1, 14)))
        assert token_ids.encode(path, text, 0)[:-1].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_one_worker_of_a_task_finds_the_near_copies(spark, monkeypatch):
    """The rows that may be copies are picked and their sets formed by one Python function: two took two workers of each task."""
    plans = {}
    stored = jaccard.materialize

    def noted(df, purpose):
        plans[purpose] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, purpose)

    monkeypatch.setattr(jaccard, "materialize", noted)
    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, text), (2, text), (3, None), (None, text + " more"), (4, "alone it stands here now")], "doc_id long, text string")
    out = jaccard.without_copies(docs, 5, 80).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text is None) for r in out) == [(False, 1, False), (False, 3, True), (False, 4, False)]
    assert plans["held"].count("ArrowEvalPython") == 1
