"""Documents as lines with their context: section, block, table header, front matter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD_SECTION = "报告头部"  # fixed value: section name before the first heading


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def lines(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per line, numbered from 1."""
    rows = docs.select(*keys, F.posexplode(F.split(text, r"\R")).alias("__i", "raw_line"))
    return rows.select(*keys, (F.col("__i") + 1).alias("line"), "raw_line", strip(F.col("raw_line")).alias("stripped"))


def in_context(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds to every line the section it stands in, whether it is inside a YAML block, and its table header.

    One exchange by document; a document was one row before, so its lines fit one task.
    """
    s = F.col("stripped")
    opens, closes = s.startswith("```yaml"), s == "```"
    heading = s.rlike(r"^#{1,6}\s+")
    table = s.startswith("|")
    ruler = table & s.rlike(r"^\|?[\s:|-]+\|?$")
    marked = rows.withColumns(
        {
            "is_heading": heading,
            "__fence": F.when(opens, True).when(closes, False),
            "__title": F.when(heading, F.regexp_replace(s, r"^[#\s]+|[#\s]+$", "")),
            "__table": table,
            "__ruler": ruler,
            "__break": (~table & (s != "")).cast("int"),
        }
    )
    doc = Window.partitionBy(*keys).orderBy("line")
    upto, before = doc.rowsBetween(Window.unboundedPreceding, 0), doc.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.last("__fence", ignorenulls=True).over(before), F.lit(False))
    fenced = marked.withColumns(
        {
            "__inside": inside,
            "section": F.coalesce(F.last("__title", ignorenulls=True).over(upto), F.lit(HEAD_SECTION)),
        }
    ).withColumns(
        {
            "fence_end": closes & F.col("__inside"),
            "in_yaml": opens | (F.col("__inside") & ~closes),
        }
    )
    blocks = fenced.withColumn("__block", F.sum(F.when(F.col("fence_end"), 0).otherwise(F.col("__break"))).over(upto))
    # the header is the last row above the first ruler of a block
    block = Window.partitionBy(*keys, "__block").orderBy("line")
    above = block.rowsBetween(Window.unboundedPreceding, -1)
    row = F.col("__table") & ~F.col("__ruler")
    seen = blocks.withColumn("__rows_above", F.coalesce(F.max(row.cast("int")).over(above), F.lit(0)))
    seen = seen.withColumn("__ruled", (F.col("__ruler") & (F.col("__rows_above") == 1)).cast("int"))
    seen = seen.withColumn("__rulers_above", F.coalesce(F.sum("__ruled").over(above), F.lit(0)))
    candidate = F.when(row & (F.col("__rulers_above") == 0), s)
    header = F.last(candidate, ignorenulls=True).over(above)
    out = seen.withColumn("table_header", F.when(F.col("__table") & (F.col("__rulers_above") > 0), header))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def cells(row: Column) -> Column:
    """Trimmed cells of a table row."""
    inner = F.regexp_replace(row, r"^\|+|\|+$", "")
    return F.transform(F.split(inner, r"\|"), strip)


def under_heading(docs: DataFrame, keys: Sequence[str], heading: str, text: str = "text") -> DataFrame:
    """Lines below the first occurrence of ``heading`` up to the next second-level heading."""
    at = F.instr(F.col(text), heading)
    body = F.substring(F.col(text), at + F.lit(len(heading)), F.length(text))
    body = F.element_at(F.split(body, r"(?m)^##\s+", 2), 1)
    return lines(docs.filter(at > 0).select(*keys, body.alias("__body")), keys, "__body")


def region(text: Column, heading: str) -> Column:
    """The same lines as an array, stripped; empty where the heading is missing."""
    at = F.instr(text, heading)
    body = F.element_at(F.split(F.substring(text, at + F.lit(len(heading)), F.length(text)), r"(?m)^##\s+", 2), 1)
    return F.when(at > 0, F.transform(F.split(body, r"\R"), strip)).otherwise(F.array().cast("array<string>"))


# Texts of rows nobody has filled in.
PLACEHOLDER_ROWS = ("待填写", "页面路径", "管理层论述（年报章节+原文摘录）")
HEADER_CELLS = ("#", "必检项")


def filled_row(s: Column) -> Column:
    """Whether a stripped line is a filled table row."""
    kept = s.startswith("|") & ~s.rlike(r"^\|[\s:|-]+\|$")
    for p in PLACEHOLDER_ROWS:
        kept = kept & ~s.contains(p)
    return kept & (F.size(cells(s)) >= 3) & ~F.element_at(cells(s), 1).isin(*HEADER_CELLS)


def table_rows(docs: DataFrame, keys: Sequence[str], heading: str, text: str = "text") -> DataFrame:
    """Filled table rows under a heading, as cell arrays."""
    rows = under_heading(docs, keys, heading, text)
    s = F.col("stripped")
    kept = rows.filter(s.startswith("|") & ~s.rlike(r"^\|[\s:|-]+\|$"))
    for p in PLACEHOLDER_ROWS:
        kept = kept.filter(~F.col("stripped").contains(p))
    split = kept.withColumn("cells", cells(s))
    return split.filter((F.size("cells") >= 3) & ~F.element_at("cells", 1).isin(*HEADER_CELLS))


def table_row_counts(docs: DataFrame, keys: Sequence[str], heading: str, text: str = "text") -> DataFrame:
    """Number of filled rows per document, zero included."""
    counts = table_rows(docs, keys, heading, text).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return docs.select(*keys).join(counts, list(keys), "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def numbered_items(docs: DataFrame, keys: Sequence[str], heading: str, text: str = "text") -> DataFrame:
    """Items of the numbered list under a heading, without emphasis marks."""
    rows = under_heading(docs, keys, heading, text)
    item = F.regexp_extract("raw_line", r"^\d+\.\s+(.+)$", 1)
    return rows.filter(item != "").select(*keys, "line", strip(F.replace(item, F.lit("**"), F.lit(""))).alias("item"))


# --- sections --------------------------------------------------------------------

# Section headings of annual reports and report kinds.
SECTION_HEADING = r"第[一二三四五六七八九十百千]+[章节部]\s"
KIND_WINDOW = 2000
HALF_YEAR_WORDS = ("半年报", "半年度报告")
QUARTER_WORDS = ("季报", "季度报告")
PREFACE, CONTENTS, BODY, WHOLE = "前言及目录", "重要提示及目录", "正文", "全文"
CANONICAL_SECTIONS = {
    "重要提示、目录和释义": ("重要提示", "目录和释义"),
    "公司简介和主要财务指标": ("公司简介和主要财务指标", "公司基本情况", "主要会计数据和财务指标"),
    "管理层讨论与分析": ("管理层讨论与分析", "经营情况讨论与分析"),
    "公司治理": ("公司治理", "股东大会情况"),
    "环境和社会责任": ("环境和社会责任", "社会责任", "环境保护"),
    "重要事项": ("重要事项", "重大事项"),
    "股份变动及股东情况": ("股份变动及股东情况", "股东和实际控制人情况"),
    "债券相关情况": ("债券相关情况", "公司债券"),
    "财务报告": ("财务报告", "审计报告", "合并资产负债表"),
}


def report_kind(text: Column) -> Column:
    """Annual, half-year or quarterly, decided by the opening of the text."""
    head = F.substring(text, 1, KIND_WINDOW)
    has = lambda words: F.greatest(*[head.contains(w) for w in words])
    return F.when(has(HALF_YEAR_WORDS), "semi_annual").when(has(QUARTER_WORDS), "quarterly").otherwise("annual")


def split_by_heading(docs: DataFrame, keys: Sequence[str], text: str = "text", heading: str = SECTION_HEADING) -> DataFrame:
    """Sections of a report: the heading line names a section, what precedes the first is the preface.

    Without any heading the contents marker divides the text, else it is one
    section.  A repeated heading keeps its last text.
    """
    t = F.col(text)
    parts = docs.select(*keys, t.alias("__t"), F.split(t, rf"\n(?={heading})").alias("__p"))
    has = F.size("__p") >= 2
    named = F.transform(
        "__p",
        lambda p, i: F.struct(
            i.alias("pos"),
            F.when(i == 0, F.lit(PREFACE)).otherwise(
                F.regexp_replace(strip(F.regexp_extract(p, r"^[^\n]*", 0)), r"(?U)\s+", " ")
            ).alias("section_name"),
            strip(F.when(i == 0, p).otherwise(F.regexp_replace(p, r"^[^\n]*", ""))).alias("section_text"),
        ),
    )
    named = F.filter(named, lambda s: (s["pos"] > 0) | (s["section_text"] != ""))
    spaced = F.instr("__t", "目 录")
    marker = F.when(spaced > 0, spaced).otherwise(F.instr("__t", "目录"))
    piece = lambda i, name, body: F.struct(F.lit(i).alias("pos"), F.lit(name).alias("section_name"), body.alias("section_text"))
    divided = F.array(
        piece(0, CONTENTS, strip(F.substring(F.col("__t"), F.lit(1), marker - 1))),
        piece(1, BODY, strip(F.substring(F.col("__t"), marker, F.length("__t")))),
    )
    whole = F.array(piece(0, WHOLE, strip(F.col("__t"))))
    chosen = F.when(has, named).when(marker > 1, divided).otherwise(whole)
    rows = parts.select(*keys, F.inline(chosen))
    last = Window.partitionBy(*keys, "section_name")
    return rows.withColumn("__last", F.max("pos").over(last)).filter("pos = __last").drop("__last")


def split_by_names(docs: DataFrame, keys: Sequence[str], text: str = "text", names: dict[str, Sequence[str]] = CANONICAL_SECTIONS) -> DataFrame:
    """Sections by known names and their aliases: each starts at its first mention as a heading.

    A section ends where the next one starts; the order is that of the text.
    """
    t = F.col(text)
    starts = []
    for name, aliases in names.items():
        alias = "|".join(aliases)
        pattern = (
            rf"(?mU)(?:第[一二三四五六七八九十\d]+[节章]\s*(?:{alias})"
            rf"|[一二三四五六七八九十\d]+[、.．\s]+(?:{alias})|^\s*(?:{alias})\s*$)"
        )
        at = F.regexp_instr(t, F.lit(pattern))
        starts.append(F.when(at > 0, F.struct(at.alias("start"), F.lit(name).alias("section_name"))))
    found = docs.select(*keys, t.alias("__t"), F.array_sort(F.array_compact(F.array(*starts))).alias("__s"))
    ends = F.transform(
        "__s",
        lambda s, i: F.struct(
            s["start"].alias("start"),
            s["section_name"].alias("section_name"),
            strip(F.substring(
                F.col("__t"), s["start"],
                F.coalesce(F.try_element_at(F.col("__s"), i + 2)["start"], F.length("__t") + 1) - s["start"],
            )).alias("section_text"),
        ),
    )
    whole = F.array(F.struct(F.lit(1).alias("start"), F.lit(WHOLE).alias("section_name"), F.col("__t").alias("section_text")))
    return found.filter(F.length("__t") > 0).select(*keys, F.inline(F.when(F.size("__s") > 0, ends).otherwise(whole)))


# --- front matter ------------------------------------------------------------------

FENCED = r"(?s)^---\s*\n(.*?)\n---\s*\n"


def front_matter(text: Column, strict: bool = False) -> Column:
    """The flat key block between the first two ``---`` lines, or an empty string.

    The tolerant form also accepts explanations before it and a code fence around it.
    """
    exact = F.regexp_extract(text, FENCED, 1)
    if strict:
        return exact
    bare = F.regexp_replace(F.regexp_replace(text, r"```yaml\s*\n", ""), r"\n```\s*\n", "\n")
    unfenced = F.regexp_extract(bare, FENCED, 1)
    anywhere = F.regexp_extract(text, r"(?ms)^---\s*\n(.*?)\n---\s*\n", 1)
    return F.when(exact != "", exact).when(unfenced != "", unfenced).otherwise(anywhere)


def matter_field(block: Column, name: str) -> Column:
    """One scalar of a front matter block, quotes removed; NULL when absent."""
    value = F.regexp_extract(block, rf"(?m)^{name}[ \t]*:[ \t]*(.*?)[ \t]*$", 1)
    bare = F.regexp_replace(value, r"""^["']|["']$""", "")
    return F.nullif(bare, F.lit(""))


def matter_list(block: Column, name: str) -> Column:
    """A list of a front matter block, in flow (``[a, b]``) or block (``- a``) form."""
    flow = F.regexp_extract(block, rf"(?m)^{name}[ \t]*:[ \t]*\[(.*?)\][ \t]*$", 1)
    dashed = F.regexp_extract(block, rf"(?m)^{name}[ \t]*:[ \t]*\n((?:[ \t]*-[^\n]*(?:\n|$))+)", 1)
    raw = F.when(flow != "", F.split(flow, ",")).otherwise(F.transform(F.split(dashed, "\n"), lambda x: F.regexp_replace(x, r"^\s*-", "")))
    items = F.transform(raw, lambda x: F.regexp_replace(strip(x), r"""^["']|["']$""", ""))
    return F.filter(items, lambda x: x != "")


def expert_fields(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """The identity, score and verdict a result states in its front matter."""
    block = docs.withColumn("__fm", front_matter(F.col(text)))
    fm = F.col("__fm")
    score = matter_field(fm, "score")
    names = ("expert_id", "ts_code", "verdict", "conclusion_direction", "data_date", "analysis_date", "batch_id")
    stated = {f"fm_{n}": matter_field(fm, n) for n in names}
    return block.withColumns(
        {
            **stated,
            "fm_score": F.when(score.rlike(r"^-?\d+$"), score.try_cast("int")),
            "fm_veto_triggers": matter_list(fm, "veto_triggers"),
            "has_front_matter": fm != "",
        }
    ).drop("__fm")


def expert_segments(rows: DataFrame, keys: Sequence[str], experts: Sequence[str]) -> DataFrame:
    """Lines of a merged report with the role whose part they stand in; lines before the first role drop out."""
    ids = "|".join(experts)
    mark = F.regexp_extract("raw_line", rf"""^\s*expert_id\s*:\s*["']?({ids})["']?\s*$""", 1)
    upto = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("expert_id", F.last(F.nullif(mark, F.lit("")), ignorenulls=True).over(upto)).filter(
        "expert_id is not null"
    )


# --- links and identifiers -----------------------------------------------------------

CODE = r"(\d{6}\.(?:SH|SZ|BJ))"


def identifiers(text: Column) -> list[Column]:
    """Company code, batch and manifest path a report names."""
    first = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    batches = F.regexp_extract_all(text, F.lit(r"(?mi)^\s*batch_id\s*:\s*[\"']?([0-9a-f]{16,64})[\"']?\s*$"), F.lit(1))
    return [
        first(CODE).alias("ts_code"),
        F.array_sort(F.array_distinct(batches)).alias("batch_ids"),
        strip(first(r"<!--\s*artifact_manifest:\s*([^>]+?)\s*-->")).alias("manifest_path"),
    ]


def page_links(docs: DataFrame, keys: Sequence[str], text: str = "text", pattern: str = r"\[\[(.+?)\]\]") -> DataFrame:
    """Distinct pages a document links to; a display text after ``|`` is dropped."""
    rows = docs.select(*keys, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("ref"))
    page = strip(F.element_at(F.split("ref", r"\|"), 1))
    return rows.select(*keys, page.alias("page")).filter("page <> ''").distinct()
