"""From raw documents to packed sequences: language, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of the
documents.  Null and empty texts are rejected by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, jaccard, language, packing, substrings
from ledgerlens.llm.common import documents, materialize

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str, min_margin: float = 0.002) -> DataFrame:
    """Documents whose language compression tells apart from all others."""
    model = language.learn(docs.select("text", "lang"))
    return docs.where(~language.identify(F.col("text"), model, min_margin)["rejected"])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, size: int = 5, threshold: int = 80) -> DataFrame:
    """Of documents whose word shingles are as similar, directly or through others, the one with the smallest doc_id.

    Texts that share a doc_id are documents of their own; of repeated rows one stays.
    """
    return jaccard.without_copies(docs, size, threshold)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str, least: int = substrings.LEAST) -> DataFrame:
    """Texts without the passages that stand elsewhere before; documents of which nothing remains go."""
    changed = F.size("removed_spans") > 0
    rest = substrings.deduplicate(docs, least).where(~changed | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        length = F.when(changed, F.char_length("text")).otherwise(F.col("n_chars"))
        rest = rest.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return rest.select(docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer: str = TOKENIZER, capacity: int = 1024) -> DataFrame:
    """The tokens of all documents as pieces of sequences."""
    return packing.pack(docs, tokenizer, capacity)


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("repeats", without_repeats),
    ("benchmark", without_leaks),
    ("packing", packed),
]
#: No SQL: compression, chunking and tokenization have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each stored and read again by the next."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
