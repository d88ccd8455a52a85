"""Quality rules: counts of each text, fixed limits, and an isolation forest over what other rules measure.

Words are runs of characters other than ASCII white space.  Every whole text gives n_words, word_chars,
n_symbols, n_dup_lines and n_repeat_words; ``base_failed`` is what two fixed limits reject.  The other documents
are judged by the rules of ``statistics()``.  Each has a range, between the ``TAIL`` and 1 - ``TAIL`` points of
all documents labelled good, on a grid of 1 / ``GRID``; how far a text lies outside, as a share of that and the
range, is what the forest looks at.  The fewer random splits it takes to set a text apart, the higher its anomaly

    score = 2 ^ -(mean path length / c(tree rows)),      c(n) = 2 H(n - 1) - 2 (n - 1) / n.

The forest grows ``trees`` trees, each of ``tree_rows`` rows drawn from a bounded sample: the ``sample_rows``
distinct labelled texts (that have not failed) which come first by a hash of their content.  The threshold comes from *all* labelled
documents: their scores are counted in steps of 1 / ``STEPS``, and among the thresholds that lose at most the share
``lost`` of the good ones, the one that rejects most bad ones is taken, the highest of equal ones.  Texts are read
once; all later steps see their counts only.

Null and empty texts have no words and fail.  Labels without a document and qualities other than 0 and 1 do
not count; a doc_id labelled twice, or held by several rows, counts each time; null doc_ids have no label.  Without
good labelled texts no forest grows: scores are 0 and only the fixed limits reject.  Without bad ones the threshold loses no
good document.  Repeated rows get equal verdicts, an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import importable, materialize

LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words
TAIL = 0.001
GRID = 1000
MOST = 1000.0  # statistics beyond count as this, so that the grid has an end
SOFTEN = 0.1
SAMPLE_ROWS = 4096
TREES = 100
TREE_ROWS = 256
LOST = 0.005
STEPS = 10_000
SEED = 20_011
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
SHOUTS = "!?"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_marks", "n_distinct"]


def repeated_words(ids: np.ndarray, of: np.ndarray, n_texts: int) -> np.ndarray:
    """Per text, words that lie in a window of three words found twice or more in the text; ids are below 2 ** 31."""
    width = int(ids.max(initial=0)) + 1
    at = np.flatnonzero(of[2:] == of[:-2]) if len(ids) > 2 else np.zeros(0, np.int64)
    pairs = ids[at] * width + ids[at + 1]
    if width >= 1 << 20:  # three would not fit into 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs * width + ids[at + 2]
    order = np.lexsort((windows, of[at]))
    same = (windows[order][1:] == windows[order][:-1]) & (of[at][order][1:] == of[at][order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    return np.bincount(of[covered], minlength=n_texts)


def count_texts(texts: list[str | None]) -> dict[str, np.ndarray]:
    texts = [t or "" for t in texts]
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # bytes split at ASCII white space only
    known: dict[bytes, int] = {}
    n = np.array([len(ws) for ws in split], np.int64)
    ids = np.fromiter((known.setdefault(w, len(known)) for ws in split for w in ws), np.int64, int(n.sum()))
    lines = [[x for x in t.split("\n") if x.strip(SPACES)] for t in texts]

    def chars(of: str) -> list[int]:
        return [sum(map(t.count, of)) for t in texts]
    upper = [sum(map(bytes.isupper, ws)) for ws in split]
    out = {"n_words": n, "word_chars": [len(t) - k for t, k in zip(texts, chars(SPACES), strict=True)], "n_symbols": chars(SYMBOLS),
           "n_dup_lines": [len(x) - len(set(x)) for x in lines], "n_repeat_words": repeated_words(ids, np.repeat(np.arange(len(texts)), n), len(texts)),
           "n_lines": [len(x) for x in lines], "n_upper": upper, "n_shouts": chars(SHOUTS), "n_marks": chars(".,;:"),
           "n_distinct": [len(set(ws)) for ws in split]}
    return {k: np.asarray(v, np.int64) for k, v in out.items()}


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text and the counts of every document."""
    importable()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            digest = np.array([xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) for t in texts], np.uint64).view(np.int64)
            columns = {"doc_id": batch["doc_id"], "digest": pa.array(digest)} | {k: pa.array(v) for k, v in count_texts(texts).items()}
            yield pa.RecordBatch.from_pydict(columns)
    schema = "doc_id long, digest long, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, schema)


def share(part: str, of: str) -> Column:
    return F.col(part) / F.greatest(F.col(of), F.lit(1))


def statistics() -> dict[str, Column]:
    """What the rules measure, from the counts."""
    spread = F.log1p(F.col("n_distinct")) / F.greatest(F.log1p(F.col("n_words")), F.lit(1e-9))
    found = {"word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "n_words"), "repeated": share("n_repeat_words", "n_words"),
             "dup_lines": share("n_dup_lines", "n_lines"), "upper": share("n_upper", "n_words"), "shouts": share("n_shouts", "n_words"),
             "marks": share("n_marks", "n_words"), "line_words": F.log1p(share("n_words", "n_lines")), "distinct": spread}
    return {k: F.least(v, F.lit(MOST)) for k, v in found.items()}


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2.0 * sum(1.0 / k for k in range(1, n)) - 2.0 * (n - 1) / n


class Forest:
    """Isolation trees as arrays: the column and value of each split, the place of its left child, the length at a leaf."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.size = min(tree_rows, len(rows))
        self.depth = max(1, math.ceil(math.log2(max(2, self.size))))
        self.trees = [self.grow(rows[np.sort(draw.choice(len(rows), self.size, replace=False))], draw) for _ in range(trees)] if len(rows) else []

    def grow(self, rows: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, ...]:
        column, value, child, length = [-1], [0.0], [0], [0.0]
        todo = [(0, 0, rows)]
        for node, depth, held in todo:
            low, high = held.min(0), held.max(0)
            wide = np.flatnonzero(high > low)
            if depth == self.depth or not len(wide):
                length[node] = depth + mean_path(len(held))
                continue
            at = int(draw.choice(wide))
            cut = draw.uniform(low[at], high[at])
            left = held[:, at] <= cut  # the cut lies below the highest, so that both sides have rows
            column[node], value[node], child[node] = at, cut, len(column)
            todo += [(len(column), depth + 1, held[left]), (len(column) + 1, depth + 1, held[~left])]
            for of, start in ((column, -1), (value, 0.0), (child, 0), (length, 0.0)):
                of += [start, start]
        return np.array(column), np.array(value), np.array(child), np.array(length)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.trees or self.size < 2:
            return np.zeros(len(rows))
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for column, value, child, length in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                inner = column[node] >= 0
                right = rows[every, np.maximum(column[node], 0)] > value[node]
                node = np.where(inner, child[node] + right, node)
            total += length[node]
        return 2.0 ** -(total / len(self.trees) / mean_path(self.size))


def ranges(good: DataFrame, tail: float) -> dict[str, tuple[float, float]]:
    """Of each statistic the values that a share ``tail`` of the good rows lies below, and above: exact on the grid."""
    names = list(statistics())
    cells = good.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.floor(F.col(k) * GRID).alias("cell")) for k in names])).alias("x"))
    counts = cells.groupBy("x.name", "x.cell").count()
    up, down = Window.partitionBy("name").orderBy("cell"), Window.partitionBy("name").orderBy(F.desc("cell"))
    ranked = counts.withColumns({"below": F.sum("count").over(up), "above": F.sum("count").over(down)})
    total = F.sum("count").over(Window.partitionBy("name"))
    ends = ranked.withColumn("total", total).groupBy("name").agg(
        F.min(F.when(F.col("below") > F.col("total") * tail, F.col("cell"))).alias("low"),
        F.max(F.when(F.col("above") > F.col("total") * tail, F.col("cell"))).alias("high"))
    return {r["name"]: (r["low"] / GRID, (r["high"] + 1) / GRID) for r in ends.collect()}  # one row of each statistic


def outside(limits: dict[str, tuple[float, float]]) -> Column:
    def beyond(name: str) -> Column:
        low, high = limits[name]
        far = F.greatest(F.lit(0.0), F.lit(low) - F.col(name), F.col(name) - F.lit(high))
        return far / (far + (high - low + SOFTEN))
    return F.array(*map(beyond, statistics()))


def threshold(labelled: DataFrame, lost: float) -> int:
    """The last step of the score that is kept."""
    steps = {r.step: (r.good, r.bad) for r in labelled.groupBy("step").agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).collect()}  # at most STEPS + 1 rows
    allowed = lost * sum(g for g, _ in steps.values())
    best, chosen, good, bad = -1, STEPS, 0, 0
    for step in range(STEPS, -1, -1):  # keep up to this step: what lies above is rejected
        if good > allowed:
            break
        if bad > best:
            best, chosen = bad, step
        good, bad = good + steps.get(step, (0, 0))[0], bad + steps.get(step, (0, 0))[1]
    return chosen


def assess(docs: DataFrame, labels: DataFrame, tail: float = TAIL, lost: float = LOST, sample_rows: int = SAMPLE_ROWS,
           trees: int = TREES, tree_rows: int = TREE_ROWS) -> DataFrame:
    """doc_id, the counts, base_failed, score and kept of every document."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = materialize(counted(docs).withColumn("base_failed", failed).withColumns(statistics()), "quality-counts")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    labelled = materialize(rows.where(~F.col("base_failed")).join(known, "doc_id"), "quality-labels")
    limits = ranges(labelled.where("quality = 1"), tail)
    if not limits:
        return rows.select("doc_id", *COUNTS[:5], "base_failed", F.lit(0.0).alias("score"), (~F.col("base_failed")).alias("kept"))
    sample = labelled.select("digest", outside(limits).alias("x")).distinct().orderBy("digest").limit(sample_rows)
    forest = Forest(np.array([r.x for r in sample.collect()], float), trees, tree_rows)  # at most sample_rows rows

    @F.pandas_udf("double")
    def anomaly(x: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(limits)))))
    score = anomaly.asNondeterministic()(outside(limits))  # so that no plan evaluates it twice
    step = F.floor(F.col("score") * STEPS)
    last = threshold(labelled.select("quality", score.alias("score")).select("quality", step.alias("step")), lost)
    judged = rows.withColumn("score", score)
    return judged.select("doc_id", *COUNTS[:5], "base_failed", "score", (~F.col("base_failed") & (step <= last)).alias("kept"))
