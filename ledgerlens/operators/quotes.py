"""Quoted passages of analyst results, found in report sections.

A quote stands in a section if its characters, punctuation and blanks left out, stand there one after the
other.  The distinct passages that results look for in one report of one company are put together first, and
each of its sections is searched for them once; no section's text is joined to a quoting line.

A report that is asked for more than ``MANY`` passages is searched in time that does not follow their number: a passage
is cut into anchors of ``WIDTH`` characters, the last one flush with its end, and sections are posted as (anchor, place).
Anchors of one passage that agree on where it would begin, all of them, are the passage: postings and anchors meet by equality.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import claims as K
from ledgerlens.operators import lines as L

NARRATIVE = "## 叙事–数据交叉验证"  # fixed value
LOCATOR_HEAD = "年报:"
LOCATOR = rf"{LOCATOR_HEAD}(\d{{4}})/([^|`；、\s/]+)/([^|`；、\s）)]+)"
NOT_WORD = r"[^\w一-鿿]"
WIDTH = 6
MANY = 100


def bare(text: Column) -> Column:
    """Text without punctuation and blanks."""
    return F.regexp_replace(text, f"(?U){NOT_WORD}", "")


def narrative_rows(text: Column) -> Column:
    """Numbered rows of the narrative table: row, field_cell, locators, chunks (quoted passages, bare) and cited paths."""
    def parts(r: Column, cell: Column) -> Column:
        return F.struct(
            r["row"].alias("row"), F.coalesce(F.try_element_at(cell, F.lit(3)), F.lit("")).alias("field_cell"), locators(r["line"]).alias("locators"),
            chunks(cell).alias("chunks"), F.array_distinct(K.cited_paths(r["line"])).alias("cited"), r["line"].alias("line"))
    return _each(_numbered(text), parts)


def _numbered(text: Column) -> Column:
    """Numbered lines below the heading with their place among all lines there."""
    lines = F.transform(L.region(text, NARRATIVE), lambda s, i: F.struct(i.alias("row"), s.alias("line")))
    return F.filter(lines, lambda r: r["line"].rlike(r"^\|\s*\d+\s*\|"))


def _each(rows: Column, parts: Callable[[Column, Column], Column]) -> Column:
    """``parts`` of each row and its cells, which are parted once: an array of one."""
    return F.flatten(F.transform(rows, lambda r: F.transform(F.array(L.cells(r["line"])), lambda cell: parts(r, cell))))


def locators(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(line, F.lit(f"({LOCATOR})"), F.lit(1)))


def chunks(cell: Column) -> Column:
    """The quoted passages of the second cell, bare, that are long enough to be looked for."""
    said = F.coalesce(F.try_element_at(cell, F.lit(2)), F.lit(""))
    quoted = F.flatten(F.transform(F.regexp_extract_all(said, F.lit(r"[“\"]([^”\"]+)[”\"]"), F.lit(1)), lambda q: F.split(q, r"…+|\.{3,}")))
    return F.array_distinct(F.filter(F.transform(quoted, bare), lambda c: F.length(c) >= WIDTH))


def quote_rows(docs: DataFrame, keys: Sequence[str], more: Sequence[str] = (), text: str = "text") -> DataFrame:
    """One row per narrative row and locator: row, chunks, year, kind and section."""
    # every locator begins alike, so that lines without one are not taken apart
    located = F.filter(_numbered(F.col(text)), lambda r: r["line"].contains(LOCATOR_HEAD))
    found = _each(located, lambda r, cell: F.struct(r["row"].alias("row"), chunks(cell).alias("chunks"), locators(r["line"]).alias("locators")))
    rows = docs.select(*keys, *more, F.explode(found).alias("r")).select(*keys, *more, "r.row", "r.chunks", F.explode("r.locators").alias("locator"))
    part = lambda i: F.regexp_extract("locator", LOCATOR, i)
    section = F.regexp_replace(part(3), r"^第[^\s“\"]{0,12}节|[“”\"]", "")
    return rows.where(F.size("chunks") > 0).select(*keys, *more, "row", "chunks", part(1).alias("year"), part(2).alias("kind"), section.alias("section"))


def postings(sections: DataFrame, keys: Sequence[str], text: str = "section_text") -> DataFrame:
    """Every anchor of every text with the place where it begins."""
    chars = F.split(bare(F.col(text)), "")
    cut = sections.select(*keys, chars.alias("c")).where(F.size("c") >= WIDTH)
    anchor = lambda i: F.concat(*[F.get("c", i + k) for k in range(WIDTH)])
    places = F.sequence(F.lit(0), F.size("c") - WIDTH)
    return cut.select(*keys, F.inline(F.transform(places, lambda i: F.struct(i.alias("place"), anchor(i).alias("anchor")))))


def anchors(chunk: Column) -> Column:
    """(offset, anchor) of a passage: side by side, the last flush with the end."""
    last = F.length(chunk) - WIDTH
    steps = F.array_union(F.sequence(F.lit(0), last, F.lit(WIDTH)), F.array(last))
    return F.transform(steps, lambda o: F.struct(o.alias("offset"), F.substring(chunk, o + 1, F.lit(WIDTH)).alias("anchor")))


def held_rows(quotes: DataFrame, sections: DataFrame, keys: Sequence[str], company: str = "ts_code", many: int | None = None) -> DataFrame:
    """(keys, row) of the narrative rows of which a passage stands in a section that the locator names.

    The section name only has to contain the located name.
    """
    many = MANY if many is None else many
    where = [company, "year", "kind"]
    spot = list(dict.fromkeys([*keys, company]))
    named = sections.select(company, F.col("report_year").cast("string").alias("year"), F.col("report_type").alias("kind"), "section_name", "section_text")
    said = quotes.select(*spot, "row", *[c for c in where if c not in spot], "section", F.explode("chunks").alias("chunk"))
    asked = said.groupBy(*where).agg(F.collect_set(F.struct("section", "chunk")).alias("asked"))

    few = named.join(asked.where(F.size("asked") <= many).hint("merge"), where)
    # an array of one, so that the text is stripped once and not for each passage
    stands = F.flatten(F.transform(F.array(bare(F.col("section_text"))), lambda body: F.filter(
        "asked", lambda a: F.col("section_name").contains(a["section"]) & body.contains(a["chunk"]))))
    found = few.select(*where, F.inline(stands)).distinct()
    held = said.join(found.hint("merge"), [*where, "section", "chunk"], "left_semi").select(*keys, "row")

    crowded = asked.where(F.size("asked") > many).select(*where).hint("merge")
    return held.unionByName(_held_by_anchors(said.join(crowded, where, "left_semi"), named.join(crowded, where, "left_semi"), keys, where)).distinct()


def _held_by_anchors(said: DataFrame, located: DataFrame, keys: Sequence[str], where: Sequence[str]) -> DataFrame:
    """The same through postings of the sections."""
    # rows of one name are parts of their own
    place = [*where, "section_name", "part"]
    posted = postings(located.withColumn("part", F.xxhash64("section_text")), place)
    wanted = said.select("*", F.size(anchors(F.col("chunk"))).alias("needed"), F.inline(anchors(F.col("chunk"))))
    hits = wanted.join(posted.hint("merge"), [*where, "anchor"]).where(F.col("section_name").contains(F.col("section")))
    begins = hits.withColumn("start", F.col("place") - F.col("offset"))
    one = list(dict.fromkeys([*keys, "row", "chunk", *place, "start"]))
    agree = begins.groupBy(*one, "needed").agg(F.count_distinct("offset").alias("met"))
    return agree.where(F.col("met") == F.col("needed")).select(*keys, "row")


def verified_rows(text: Column, quoted: Column, known: Callable[[Column], Column]) -> Column:
    """Distinct narrative rows that hold up: quoted, with a cited path that is known and named in the field cell.

    The same evidence in several rows counts once.
    """
    held = F.filter(narrative_rows(text), lambda r: F.array_contains(quoted, r["row"]))
    real = F.transform(held, lambda r: F.struct(
        F.array_sort(r["locators"]).alias("l"), F.array_sort(r["chunks"]).alias("c"), F.array_sort(F.filter(r["cited"], known)).alias("p"), r["field_cell"].alias("f")))
    bound = F.filter(real, lambda r: F.exists(r["p"], lambda p: r["f"].contains(p)))
    return F.size(F.array_distinct(F.transform(bound, lambda r: F.struct(r["l"], r["c"], r["p"]))))
