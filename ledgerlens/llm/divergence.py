"""How far the sources of each language lie apart in their use of words, and the terms that set a source off.

Terms are runs of ASCII letters and of characters beyond ASCII, A to Z in lower case; null text, lang and source
count as ''.  One ``CountVectorizer`` with ``minDF`` and the largest integer as ``vocabSize`` learns the vocabularies
of all languages in one pass: each term carries its document's language, so document frequencies and entries are
those of the language, however many languages there are; the fit sees each term of a document once.  The exact sparse
vectors are summed by source; documents of one source that a task reads one after the other are one bag of terms, whose
vector is the sum of theirs, so fewer entries are summed.
With V kept terms in the language and N occurrences of them in the group, a term that the group uses n times weighs

    p = 1 + floor(1e9 * (n + 2) / (N + 2 V)),      f(p, q) = floor((p - q)^2 / (p + q))

and two sources differ by the sum of f over all kept terms of their language.  Most terms are in few sources,
so the sum is taken from what is there: all terms absent from both, corrected by each source's own terms (once per
distinct count), corrected by the terms that two sources share.  Only these meet in pairs, in blocks of
``TERM_BLOCK`` terms and at most two blocks of about ``SOURCE_BLOCK`` sources.

All numbers are integers.  A language without a kept term gives pairs of value 0 and no terms; a group without terms
gives every term n = 0; a language with a single source has no pairs; an empty table gives no rows.  Repeated
rows are documents of their own.  Equal values are ranked by item in the order of its UTF-8 bytes.

The vocabulary, terms in at least ``min_docs`` documents, passes through the driver and is broadcast by the
model itself, as ``CountVectorizer`` does it; it grows with the distinct words of the corpus, not with the texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import importable, materialize, shared_dir

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
TERM_BLOCK = 2048
SOURCE_BLOCK = 128
BAG_BYTES = 8_000_000  # of terms that a task holds at a time
MARK = b"\x1f"  # stands between language and term; no term holds it
BLANKS = bytes(x if x >= 0x80 or chr(x).isalpha() else 0x20 for x in range(256))


def labelled_terms(docs: DataFrame, bags: bool = False) -> DataFrame:
    """source and terms, each term behind its language; '' where there are none.

    A row is a document with each of its terms once; with ``bags`` it is some documents of one language and source
    that a task read one after the other, with all their terms.
    """
    importable()

    def found(batch: pa.RecordBatch) -> Iterator[tuple[str, str, list[bytes]]]:
        for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
            yield lang, source, text.encode().lower().translate(BLANKS).split()  # bytes: only A-Z change

    def packed(sources: list[str], langs: list[str], words: list[bytes]) -> pa.RecordBatch:
        before = {lang: quote(lang, safe="").encode() + MARK for lang in set(langs)}  # no blank within
        marked = [before[lang] + x.replace(b" ", b" " + before[lang]) if x else x for lang, x in zip(langs, words, strict=True)]
        terms = pc.split_pattern(pa.array(marked, pa.binary()).cast(pa.string()), " ")
        return pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), terms], ["source", "terms"])

    def single(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(source, lang, b" ".join(set(words))) for lang, source, words in found(batch)]
            yield packed(*([x[k] for x in rows] for k in range(3)))

    def together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[bytes]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            names = list(held)
            out = packed([source for _, source in names], [lang for lang, _ in names], [b" ".join(held[x]) for x in names])
            held.clear()
            return out

        for batch in batches:
            for lang, source, words in found(batch):
                if words:
                    held.setdefault((lang, source), []).append(b" ".join(words))
                    size += len(held[lang, source][-1])
                if size >= BAG_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    columns = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text"))
    return docs.select(*columns).mapInArrow(together if bags else single, "source string, terms array<string>")


def weight(n: Column, total: Column, kept: Column) -> Column:
    whole = "decimal(20,0)"
    share = F.call_function("div", F.lit(SCALE).cast(whole) * (n.cast(whole) + 2), total.cast(whole) + kept.cast(whole) * 2)
    return F.lit(1).cast("long") + share


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, source, place, term, n) of kept terms where n > 0, and kept terms (lang, place, term)."""
    spark = docs.sparkSession
    terms = labelled_terms(docs)
    # so that the model has an entry where no term is kept: the empty term, left out again below
    filler = spark.range(min_docs).select(F.lit("").alias("source"), F.array(F.lit("")).alias("terms"))
    counter = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs), vocabSize=2**31 - 1)
    model = counter.fit(terms.unionByName(filler))
    saved = shared_dir(spark, "vocabulary")
    model.write().save(saved)
    lang, term = (F.substring_index("entry", MARK.decode(), k) for k in (1, -1))
    kept = (spark.read.parquet(f"{saved}/data").select(F.posexplode("vocabulary").alias("place", "entry")).where("entry <> ''")
            .select(F.url_decode(lang).alias("lang"), "place", term.alias("term")))
    vectors = model.transform(labelled_terms(docs, bags=True)).select("source", F.unwrap_udt("vector").alias("v"))
    entries = vectors.select("source", F.inline(F.arrays_zip(F.col("v.indices").alias("place"), F.col("v.values").alias("n"))))
    sums = entries.groupBy("source", "place").agg(F.sum(F.col("n").cast("long")).alias("n"))  # one language per place
    return materialize(sums.join(kept, "place").select("lang", "source", "place", "term", "n"), "source-counts"), kept


def shared_terms(entries: DataFrame) -> DataFrame:
    """(lang, source, item, value): what the terms that two sources share add to the value of the pair."""
    importable()

    def evaluate(rows: pa.Table) -> pa.Table:
        names, source = np.unique(np.array(rows["source"].to_pylist(), object), return_inverse=True)
        place, block = rows["place"].to_numpy(), rows["block"].to_numpy()
        one_block = rows["low"][0].as_py() == rows["high"][0].as_py()
        order = np.lexsort((source, place))
        place, block, source = place[order], block[order], source[order]
        p, absent = rows["p"].to_numpy()[order], rows["absent"].to_numpy()[order]

        def f(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (a - b) * (a - b) // (a + b)

        sums, seen = np.zeros(len(names) ** 2, np.int64), np.zeros(len(names) ** 2, bool)
        for step in range(1, len(names)):
            left = np.flatnonzero(place[step:] == place[:-step])
            if not len(left):
                break
            right = left + step
            if not one_block:
                meet = block[left] != block[right]
                left, right = left[meet], right[meet]
            both = f(p[left], p[right]) - f(p[left], absent[right]) - f(absent[left], p[right]) + f(absent[left], absent[right])
            pair = source[left] * len(names) + source[right]
            np.add.at(sums, pair, both)
            seen[pair] = True
        pair = np.flatnonzero(seen)
        lang = pa.array([rows["lang"][0].as_py()] * len(pair), pa.string())
        return pa.table({"lang": lang, "source": pa.array(names[pair // len(names)].tolist(), pa.string()),
                         "item": pa.array(names[pair % len(names)].tolist(), pa.string()), "value": sums[pair]})

    own = F.pmod(F.xxhash64("source"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    placed = entries.select("lang", "source", "place", "p", "absent", own.alias("block"), other.alias("met"),
                            F.floor(F.col("place") / TERM_BLOCK).alias("terms"))
    placed = placed.withColumns({"low": F.least("block", "met"), "high": F.greatest("block", "met")}).drop("met")
    return placed.groupBy("lang", "terms", "low", "high").applyInArrow(evaluate, "lang string, source string, item string, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: all pairs, and the ``top`` terms of each source."""
    counts, kept = source_counts(docs, min_docs)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    names = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = names.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "v"])
    absent = F.when(F.col("v") > 0, weight(F.lit(0), F.col("total"), F.col("v")))
    groups = materialize(groups.withColumn("absent", absent), "source-groups")
    width = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCE_BLOCK).cast("long").alias("blocks"))

    used = counts.join(groups, ["lang", "source"]).withColumn("p", weight(F.col("n"), F.col("total"), F.col("v")))
    others = groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("other"))
    both_absent = gap(F.col("absent"), F.col("other"))
    pairs = groups.join(others, "lang").where(F.col("source") < F.col("item"))
    start = pairs.select("lang", "source", "item", F.coalesce(F.col("v") * both_absent, F.lit(0)).alias("value"))
    # a source's own terms, alike wherever their counts are: one row for each count
    alike = used.groupBy("lang", "source", "p", "absent").agg(F.count("*").alias("terms"))
    first, second = F.least("source", "item"), F.greatest("source", "item")
    single = alike.join(others, "lang").where(F.col("source") != F.col("item")).groupBy(F.col("lang"), first.alias("source"), second.alias("item")) \
        .agg(F.sum(F.col("terms") * (gap(F.col("p"), F.col("other")) - both_absent)).alias("value"))
    shared = shared_terms(used.join(width, "lang"))
    half = start.unionByName(single).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.inline(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_rows = half.select("lang", "value", ways).withColumn("rank", F.row_number().over(ranked))

    in_lang = counts.groupBy("lang", "place").agg(F.sum("n").alias("n"))
    lang_total = in_lang.groupBy("lang").agg(F.sum("n").alias("total")).join(sizes, "lang")
    usual = in_lang.join(lang_total, "lang").select("place", weight(F.col("n"), F.col("total"), F.col("v")).alias("q"))
    marked = used.join(usual, "place").where(F.col("p") > F.col("q"))
    term_rows = marked.select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")) \
        .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair_rows.withColumn("part", F.lit("pair")).select(columns).unionByName(term_rows.withColumn("part", F.lit("term")).select(columns))
