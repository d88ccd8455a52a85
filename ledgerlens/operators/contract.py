"""The whole contract of analyst results in one pass: every rule a bit, every document one mask.

What is known of a company - facts, paths, its snapshot and gaps, narrative rows whose quotes stand in its reports - is
one row; documents are dealt by company and meet it there once.  The rules on form are expressions over the text; all
others look at its lines, which ``judging`` reads once.  What a document says in numbers and which pages it logs comes
back line by line, narrow, and meets in one aggregate by document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import claims as K
from ledgerlens.operators import documents as D
from ledgerlens.operators import judging as J
from ledgerlens.operators import lines as L
from ledgerlens.operators import quotes as Q
from ledgerlens.operators.judging import RULES, bit
from ledgerlens.runtime import materialize

KEYS = ("ts_code", "expert_id")
COMPANY = "ts_code"
#: Rules that lines, tables, citations and numbers decide; the others are rules on form.
EVIDENCE_RULES = ("R18", "R19", "R21", "R22", "R23", "R24")
#: Bytes of one Arrow batch to a Python worker, unless the session has a size of its own.
BATCH_SIZE = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def mask(checks: Sequence[tuple[str, Column]]) -> Column:
    """One number with the bits of all rules that are broken."""
    out = F.lit(0).cast("long")
    for rule, broken in checks:
        out = out.bitwiseOR(F.when(F.coalesce(broken, F.lit(False)), F.lit(bit(rule)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def known(facts: DataFrame, paths: DataFrame, snapshots: DataFrame, gaps: DataFrame, held: DataFrame, parts: int) -> DataFrame:
    """One row per company with all that its documents are judged by: no more than one company's data and the rows of its documents.

    It lies as the documents do, in ``parts`` partitions by company; otherwise the planner may exchange their texts instead.
    """
    no_gap = F.lit(False)
    sides = [
        facts.select(COMPANY, F.struct("path", F.col("value").cast("double").alias("value"), F.col("unit").cast("string").alias("unit")).alias("fact")),
        paths.select(COMPANY, F.col("path").alias("bare")),
        snapshots.select(COMPANY, F.struct("data_date", "analysis_date", "batch_id").alias("snapshot")),
        gaps.select(COMPANY, F.array(*[F.coalesce(n, no_gap) for n, _ in K.CONTRADICTIONS]).alias("gaps")),
        held.select(COMPANY, F.struct("expert_id", "row").alias("held")),
    ]
    rows = sides[0]
    for side in sides[1:]:
        rows = rows.unionByName(side, allowMissingColumns=True)
    return rows.repartition(parts, COMPANY).groupBy(COMPANY).agg(F.collect_list("fact").alias("facts"), F.collect_set("bare").alias("bare"), F.max("snapshot").alias("snapshot"),
                                     F.max("gaps").alias("gaps"), F.collect_list("held").alias("held"))


def masks(docs: DataFrame, snapshots: DataFrame, facts: DataFrame, paths: DataFrame, sections: DataFrame, checklist: DataFrame, pages: DataFrame, gaps: DataFrame,
          rules: Sequence[str] = RULES, dealt: int | None = None) -> DataFrame:
    """ts_code, expert_id, mask of every result (ts_code, expert_id, text; one row each); runs a job that stores the rows that quote.

    ``snapshots``: data_date, analysis_date, batch_id per company; ``gaps``: the missing data per company that
    ``claims.contradictions`` looks at.  Null texts count as empty; a company without snapshot disagrees with every date.
    The rules on form are left out of masks if ``rules`` has none of them.  ``dealt``: documents lie by company already, in
    that many partitions, so their texts need not be exchanged.
    """
    spark = docs.sparkSession
    if spark.sparkContext.getConf().get(BATCH_SIZE[0]) is None:
        spark.conf.set(*BATCH_SIZE)
    placed = docs.where(" and ".join(f"{k} is not null" for k in KEYS)).select(*KEYS, F.coalesce("text", F.lit("")).alias("text"))
    # a number of its own: partitions small in bytes are heavy in searches, and must not be put together
    parts = dealt or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not dealt:
        placed = placed.repartition(parts, COMPANY)
    # narrow and asked for several times: stored, so that narrative tables are read once
    quotes = materialize(Q.quote_rows(placed, KEYS), "quotes")
    held = Q.held_rows(quotes, sections, KEYS, COMPANY).select(*KEYS, "row")
    items = D.item_terms(checklist).groupBy("expert_id").agg(F.to_json(F.collect_list(F.struct("item", "terms", "token_groups"))).alias("expected"))
    # tables with rows for every company look small to the planner in their compressed files; they are sorted, not sent to the driver
    whole = placed.join(known(facts, paths, snapshots, gaps, held, parts).hint("merge"), COMPANY, "left").join(F.broadcast(items), "expert_id", "left")
    form = F.lit(0).cast("long")
    if not set(rules) <= set(EVIDENCE_RULES):
        whole = L.expert_fields(whole, KEYS).withColumns(D.form_columns(F.col("text")))
        form = mask(D.form_checks({c: F.col(f"snapshot.{c}") for c in ("data_date", "analysis_date", "batch_id")}))
    judged = whole.select(*KEYS, "text", form.alias("mask"), "expected", "gaps", "facts", "bare", "held").mapInArrow(J.judged, J.JUDGED)
    # the first line stands for the document, so that none is lost; of the others only those with numbers go on, and the pages
    rows = judged.where((F.col("line") == 1) | ((F.col("data") > 0) | F.col("page").isNotNull()))
    names = pages.select(F.regexp_replace("page", r"\.md$", "").alias("page")).distinct().withColumn("real", F.lit(True))
    per = rows.join(F.broadcast(names), "page", "left").groupBy(*KEYS).agg(
        F.max("mask").alias("mask"), *[F.sum(c).alias(c) for c in ("data", "traced", "paths")], F.count("real").alias("pages"))
    broad = (F.col("data") >= 5) & (F.col("traced") >= 5) & (F.col("paths") >= 3)
    more = mask([("R19", F.col("pages") < 3), ("R24", ~broad | (F.col("traced") < F.col("data")))])
    return per.select(*KEYS, F.col("mask").bitwiseOR(more).alias("mask"))


def broken_rules(masked: DataFrame) -> DataFrame:
    """One row per result and broken rule."""
    rules = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(bit(r)).cast("long")) != 0, F.lit(r)) for r in RULES]))
    return masked.select(*KEYS, F.explode(rules).alias("rule_id"))


def audit(docs: DataFrame, snapshots: DataFrame, facts: DataFrame, paths: DataFrame, sections: DataFrame, checklist: DataFrame, pages: DataFrame, gaps: DataFrame,
          rules: Sequence[str] = RULES, dealt: int | None = None) -> DataFrame:
    """All broken rules R2 to R24 of all results, or those of ``rules``."""
    found = broken_rules(masks(docs, snapshots, facts, paths, sections, checklist, pages, gaps, rules, dealt))
    return found if set(rules) == set(RULES) else found.where(F.col("rule_id").isin(*rules))
