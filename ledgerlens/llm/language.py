"""Language identification by compression.

Each language has a zstandard dictionary of raw content: words of its own training texts, the most frequent
last, where references are cheapest.  Whole passages are not kept: one that documents of several languages
share would speak for each of them.  A word goes to the language that uses it most, by share of its words.
Of a text its words count, runs of letters in lower case with blanks between.  It is cut into blocks of ``BLOCK`` bytes, so that the dictionary and not the text's own earlier part explains
each block; every block is compressed once with each dictionary, and the language of the smallest sum wins.
The relative gap to the second is the margin; a margin below ``min_margin`` rejects the document.

Learning looks at a bounded sample: per language the ``sample_docs`` distinct training texts that come first
by a hash of their content, each once however often it is copied, of each a stretch of at most ``sample_chars``
characters around its middle; a dictionary has at most ``dictionary_bytes``.  Prediction compresses whole texts, and looks at nothing but the text.

Null texts and texts without a letter get ``und`` with score 0 and are rejected, and so does everything if
nothing could be learned.  With a single learned language the score is 1.  Equal sums go to the language
that sorts first, with margin 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import importable

WORD = re.compile(r"[^\W\d_]+")
DICTIONARY_BYTES = 16_000
BLOCK = 2048
LEVEL = 6
UNKNOWN = "und"
VERDICT = "lang_pred string, score double, margin double, rejected boolean"

Model = tuple[tuple[str, bytes], ...]


def held_out(doc_id: Column) -> Column:
    """One document in five, by its id, takes no part in learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = 400, sample_chars: int = 2000, dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """One dictionary per language of ``docs`` (columns text and lang; the caller leaves out what is held out)."""
    known = docs.where(F.col("lang").isNotNull() & (F.trim("lang") != "") & F.col("text").rlike(r"\p{L}"))
    size = F.char_length("text")
    middle = F.greatest(F.lit(1), F.floor((size - sample_chars) / 2) + 1).cast("int")
    rows = known.select("lang", F.xxhash64("text").alias("draw"), F.substring("text", middle, F.lit(sample_chars)).alias("stretch"))
    # copies of a text have one draw and count once; tasks leave out repeated draws before anything is shuffled, and windows
    # keep their first rows, so neither a copied text nor a frequent language sends more than another
    first = Window.partitionBy("lang").orderBy("draw")
    lowest = rows.select("lang", "draw").distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample_docs)
    last = lowest.groupBy("lang").agg(F.max("draw").alias("last")).collect()  # one number of each language
    if not last:
        return ()
    limit = F.create_map(*[F.lit(x) for r in last for x in (r.lang, r.last)])
    drawn = rows.where(F.col("draw") <= F.try_element_at(limit, F.col("lang"))).distinct()
    counts: dict[str, Counter[str]] = {}
    for row in drawn.collect():  # at most sample_docs stretches of each language
        counts.setdefault(row.lang, Counter()).update(set(words(row.stretch).split()))
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    share = {lang: {w: n / total[lang] for w, n in c.items()} for lang, c in counts.items()}
    most: dict[str, float] = {}
    for of in share.values():
        for w, x in of.items():
            most[w] = max(x, most.get(w, 0.0))
    return tuple((lang, dictionary([(w, n) for w, n in counts[lang].items() if share[lang][w] == most[w]], dictionary_bytes))
                 for lang in sorted(counts))


def dictionary(counted: Iterable[tuple[str, int]], limit: int) -> bytes:
    """Words with blanks between, the most frequent last; what exceeds the limit is cut off at the front."""
    ordered = sorted(counted, key=lambda x: (x[1], x[0]))
    return b" " + " ".join(w for w, _ in ordered).encode()[-limit:] + b" "


def words(text: str) -> str:
    return " ".join(WORD.findall(text.lower()))


class Classifier:
    def __init__(self, model: Model):
        self.langs = [lang for lang, _ in model]
        self.compress = []
        for _, content in model:
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def verdict(self, text: str | None, min_margin: float) -> tuple[str, float, float, bool]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0, True
        data = words(text).encode()
        parts = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        sizes = sorted((sum(len(compress(x)) for x in parts), lang) for compress, lang in zip(self.compress, self.langs, strict=True))
        if len(sizes) == 1:
            return sizes[0][1], 1.0, 1.0, False
        margin = 1.0 - sizes[0][0] / sizes[1][0]
        return sizes[0][1], min(1.0, 0.5 + 2.0 * margin), margin, margin < min_margin


@lru_cache(maxsize=1)
def classifier(model: Model) -> Classifier:
    """The worker process keeps the one it used last."""
    return Classifier(model)


def identify(text: Column, model: Model, min_margin: float = 0.0) -> Column:
    """Struct of lang_pred, score, margin and rejected for each text."""
    importable()

    @F.pandas_udf(VERDICT)
    def verdicts(values: pd.Series) -> pd.DataFrame:
        own = classifier(model)
        return pd.DataFrame([own.verdict(x, min_margin) for x in values], columns=["lang_pred", "score", "margin", "rejected"])
    return verdicts.asNondeterministic()(text)  # so that no plan evaluates it twice


def predict(docs: DataFrame, min_margin: float = 0.002) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected of every document, learned from those not held out."""
    out = held_out(F.col("doc_id"))
    model = learn(docs.where(~out).select("text", "lang"))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"),
                        identify(F.col("text"), model, min_margin).alias("verdict"))
            .select("doc_id", "held_out", "verdict.*"))
