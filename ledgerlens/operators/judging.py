"""One analyst result read and judged at once: the rules R18 to R24, of which each looks at lines, tables, citations or numbers.

A document is split into lines once and every line is seen once, with its section, block and table header, against what
is known of its company.  The rules are those of ``documents`` and ``claims``, which state them one by one as column
expressions; patterns keep Spark's meaning of digits, blanks and line ends.  Documents come in Arrow batches, a few hundred
at a time as Python objects; the facts of a company are put in order once for the results of it that follow one another.
"""

from __future__ import annotations

import gc
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from ledgerlens.operators.claims import (
    ASSERTIONS, CALC_TAG, CLAUSE_END, CONTRADICTIONS, DATA_WORDS, HEDGES, HISTORY_SECTIONS, INDEX_COLUMNS, LABEL_PATHS, META_FIELDS, META_SECTIONS,
    META_WORDS, MIN_PEERS, PATH, SCORE_COLUMNS, SOURCE_TAG, recompute, scan_line,
)
from ledgerlens.operators.documents import DOCUMENT_LOCATOR, EVIDENCE_DOMAINS, KNOWLEDGE_LOG, NARRATIVE, PLACEHOLDERS
from ledgerlens.operators.lines import HEAD_SECTION, HEADER_CELLS, PLACEHOLDER_ROWS
from ledgerlens.operators.quotes import LOCATOR, WIDTH

# The function travels with the job, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RULES = tuple(f"R{i}" for i in range(2, 25))
SERIES = "[*]"
#: Documents of a batch that are Python objects at a time.
STRETCH = 256
#: One row for the document (line 1), one for every line with data numbers and one for every logged page.
JUDGED = "ts_code string, expert_id string, mask long, line int, data int, traced int, paths int, page string"


def bit(rule: str) -> int:
    return 1 << RULES.index(rule)


R18, R21, R22, R23, R24 = (bit(r) for r in ("R18", "R21", "R22", "R23", "R24"))

# Spark's patterns: digits, blanks and letters are ASCII unless (?U) says otherwise, which has its own blanks and line ends.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = " \t\n\x0b\x0c\r"
ENDS = "\n\x0b\x0c\r\x85\u2028\u2029"
ROW_ENDS = "\n\r\x85\u2028\u2029"
_LINE_END = re.compile(f"\r\n|[{ENDS}]")
_DIGIT = re.compile("[0-9]")
_PATHS = re.compile(PATH, re.A)
_SOURCE, _CALC = re.compile(SOURCE_TAG, re.A), re.compile(CALC_TAG, re.A)
_LOCATED = re.compile(f"{PATH}|{DOCUMENT_LOCATOR}", re.A | re.I)
_ATOMS = re.compile(f"{PATH}|(?:年报|wiki):[^|`；、\\s]+", re.A | re.I)
_LOCATORS = re.compile(f"({LOCATOR})", re.A)
_RECORDED = re.compile(r"\|\s*([^|]+?)\s*\|\s*(DONE|MISSING)\s*\|\s*([^|]+)\|\s*([^|]+)\|", re.A | re.I)
_RULED_ROW, _RULER = re.compile(r"\|[\s:|-]+\|", re.A), re.compile(r"\|?[\s:|-]+\|?", re.A)
_HEADING = re.compile(r"#{1,6}\s", re.A)
_NUMBERED, _PAGE_MARKS = re.compile(r"\|\s*[0-9]+\s*\|", re.A), re.compile(r"\Awiki:\s*|\.md\Z", re.A)
_QUOTED, _CUT = re.compile(r"[“\"]([^”\"]+)[”\"]"), re.compile(r"…+|\.{3,}")
_INDEX, _STAT = re.compile(r"\[[0-9]+\]"), re.compile(r"industry\.industry_stats\.([^.]+)\.(?:mean|median|p25|p75)")
_RANK, _PEERS = re.compile(r"industry\.target\.([^.]+)_rank_pct"), re.compile(r"industry\.industry_stats\.([^.]+)\.count")
_ASSERTIONS = [(re.compile(p), label) for p, label in ASSERTIONS]
_CONTRADICTIONS = [re.compile(p) for _, p in CONTRADICTIONS]
_HEDGES, _CLAUSE_END = re.compile(HEDGES), re.compile(CLAUSE_END)
_DATA_WORDS = re.compile("|".join(DATA_WORDS), re.A | re.I)
_META_FIELD, _META_WORDS = re.compile(rf"\s*(?:{'|'.join(META_FIELDS)})\s*:", re.A | re.I), re.compile("|".join(META_WORDS))
_INDEX_COLUMNS, _SCORE_COLUMNS = re.compile(INDEX_COLUMNS.replace("$", r"\Z")), re.compile(SCORE_COLUMNS)
_LABELS = [(re.compile(p.removeprefix("(?i)"), re.I if p.startswith("(?i)") else 0), tokens) for p, tokens in LABEL_PATHS]
_LABEL_END = re.compile("[。；;|]")
_PRINTED = re.compile(r"-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?", re.A)
_FILLING = re.compile(f"[`*_{WHITE}]")
_GAPS = re.compile(r"\s+", re.A)


# --- texts ------------------------------------------------------------------------------


def split_lines(text: str) -> list[str]:
    if "\x1c" in text or "\x1d" in text or "\x1e" in text:
        return _LINE_END.split(text)
    out = text.splitlines()
    if not text or text[-1] in ENDS:
        out.append("")
    return out


def cells(row: str) -> list[str]:
    return [c.strip(WHITE) for c in row.strip("|").split("|")]


def region(text: str, heading: str) -> list[str]:
    """Stripped lines below a heading, up to the next second-level one."""
    at = text.find(heading)
    if at < 0:
        return []
    start = end = at + len(heading)
    while (end := text.find("##", end)) >= 0:
        if (end == start or text[end - 1] in ROW_ENDS) and text[end + 2 : end + 3] in BLANK and end + 2 < len(text):
            break
        end += 1
    return [x.strip(WHITE) for x in split_lines(text[start:end] if end >= 0 else text[start:])]


def inputs_of(tag: str) -> list[str]:
    return _PATHS.findall(tag.partition(";")[2])


def cited_paths(line: str, formulas: Sequence[str]) -> list[str]:
    """Paths cited in a line, whose formula tags are given."""
    out = [p.strip(WHITE).removeprefix("JSON.").strip("`") for t in _SOURCE.findall(line) for p in t.split(",")]
    for t in formulas:
        out += inputs_of(t)
    return [p for p in out if p]


def is_letter(c: str) -> bool:
    kind = unicodedata.category(c)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or c in "\u200c\u200d" or "\u24b6" <= c <= "\u24e9" or "\U0001f130" <= c <= "\U0001f189"


# --- what is known of a company -----------------------------------------------------------


class Known:
    """Facts by path: (value, unit, enough); other paths; points of every indexed series."""

    def __init__(self, facts: Iterable[tuple[str | None, float | None, str | None]], paths: Iterable[str | None]):
        self.facts: dict[str, tuple[float | None, str | None, bool]] = {}
        self.points: dict[str, int] = {}
        peers: dict[str, bool] = {}
        for path, value, unit in facts:
            if path is None:
                continue
            if "[" in path and _INDEX.search(path):
                series = _INDEX.sub(SERIES, path)
                self.points[series] = self.points.get(series, 0) + 1
            if path.startswith("industry.") and (m := _PEERS.fullmatch(path)):
                peers[m.group(1)] = peers.get(m.group(1), False) or (value is not None and not value < MIN_PEERS)
            # of several facts of one path the largest counts, as values are ordered in Spark
            if path not in self.facts or rank((value, unit)) > rank(self.facts[path]):
                self.facts[path] = (value, unit, True)
        for path, (value, unit, _) in self.facts.items():
            if path.startswith("industry.") and (m := _STAT.fullmatch(path) or _RANK.fullmatch(path)) and not peers.get(m.group(1), False):
                self.facts[path] = (value, unit, False)
        self.paths = {p for p in paths if p is not None}

    def exists(self, path: str) -> bool:
        return SERIES not in path and (path in self.facts or path in self.paths)

    def value(self, path: str) -> float | None:
        return self.facts[path][0] if path in self.facts else None

    def sound(self, path: str) -> bool:
        return path in self.facts and self.facts[path][0] is not None and self.facts[path][2]

    def peers(self, path: str) -> bool:
        """Whether a peer figure has enough peers behind it; one that is no statistic is fine."""
        if not _STAT.fullmatch(path):
            return True
        n = self.value(path.rpartition(".")[0] + ".count")
        return n is not None and not n < MIN_PEERS


def rank(fact: tuple) -> tuple:
    value, unit = fact[:2]
    return (value is not None, value is not None and value != value, value if value is not None and value == value else 0.0, unit is not None, unit or "")


# --- rules ----------------------------------------------------------------------------------


def filled_row(s: str) -> bool:
    if not s.startswith("|") or _RULED_ROW.fullmatch(s) or any(p in s for p in PLACEHOLDER_ROWS):
        return False
    c = cells(s)
    return len(c) >= 3 and c[0] not in HEADER_CELLS


def logged_pages(text: str) -> list[str]:
    out = []
    for s in region(text, KNOWLEDGE_LOG):
        if s.startswith("|") and len(c := cells(s)) >= 2 and c[0].isascii() and c[0].isdigit():
            out.append(_PAGE_MARKS.sub("", c[1].strip("`").strip(WHITE)))
    return list(dict.fromkeys(out))


def recorded_items(lines: Iterable[str]) -> dict[str, tuple[str, str, str]]:
    """Status, evidence and conclusion of the first row of each item."""
    out: dict[str, tuple[str, str, str]] = {}
    for x in lines:
        if x.startswith("|") and (m := _RECORDED.match(x)):
            out.setdefault(m.group(1).strip(" "), (m.group(2).upper(), m.group(3).strip(" "), m.group(4).strip(" ")))
    return out


def item_holds(status: str, evidence: str, conclusion: str, terms: Sequence[str], groups: Sequence[Sequence[str]] | None) -> bool:
    if status != "DONE" or not evidence or not conclusion or not groups or any(p in evidence or p in conclusion for p in PLACEHOLDERS):
        return False
    atoms = " ".join(_LOCATED.findall(evidence)).lower()
    said = f"{evidence} {conclusion}".lower()
    return (atoms != "" and len(_FILLING.sub("", conclusion)) >= 4 and any(t in said for t in terms)
            and all(any(t is not None and t.lower() in atoms for t in g or ()) for g in groups))


def outside_domain(role: str, path: str) -> bool:
    return role in EVIDENCE_DOMAINS and not path.startswith(EVIDENCE_DOMAINS[role])


def checklist_mask(role: str, lines: Sequence[str], expected: Sequence[Mapping], known: Known) -> int:
    if not expected:
        return 0
    rows = recorded_items(lines)
    held = [rows[e["item"]][1] for e in expected if e.get("item") in rows and item_holds(*rows[e["item"]], e["terms"], e.get("token_groups"))]
    # a share of less than 80 percent, rounded to one decimal
    out = R21 if len(held) < 1 or len(held) / len(expected) * 100 < 79.95 else 0
    if held and len({" ".join(sorted(set(_ATOMS.findall(e)))) for e in held}) < min(3, len(held)):
        out |= R22
    if any(outside_domain(role, p) or not known.exists(p) for e in held for p in _PATHS.findall(e)):
        out |= R22
    return out


def verified(text: str, held: set[int], known: Known) -> int:
    """Distinct narrative rows that hold up, of those whose quotes do."""
    if len(held) < 3:
        return len(held)  # too few, whatever they cite
    found = set()
    for i, s in enumerate(region(text, NARRATIVE)):
        if i not in held or not _NUMBERED.match(s):
            continue
        c = cells(s)
        paths = sorted({p for p in cited_paths(s, _CALC.findall(s)) if known.exists(p)})
        if not any(p in (c[2] if len(c) > 2 else "") for p in paths):
            continue
        passages = {"".join(filter(is_letter, q)) for m in _QUOTED.findall(c[1] if len(c) > 1 else "") for q in _CUT.split(m)}
        locators = {m[0] for m in _LOCATORS.findall(s)}
        found.add((tuple(sorted(locators)), tuple(sorted(q for q in passages if len(q) >= WIDTH)), tuple(paths)))
    return len(found)


def backed(label: str, paths: Iterable[str], known: Known) -> bool:
    cited = set(paths)
    if label == "industry":
        peer = [p for p in cited if p.startswith("industry.")]
        return bool(peer) and all(map(known.peers, peer))
    if label == "history":
        places: dict[str, list[str]] = {}
        for p in cited:
            if p.startswith(HISTORY_SECTIONS):
                places.setdefault(_INDEX.sub(SERIES, p), []).append(p)
        return any(len(ps) >= 2 and sum(p in known.facts for p in ps) >= known.points.get(s, 0) for s, ps in places.items())
    return False


def contradicts(lines: Sequence[str], text: str, gaps: Sequence[bool]) -> bool:
    open_ = [p for p, gap in zip(_CONTRADICTIONS, gaps) if gap and p.search(text)]
    return bool(open_) and any(
        not _HEDGES.search(c) and any(p.search(c) for p in open_) for x in lines if any(p.search(x) for p in open_) for c in _CLAUSE_END.split(x))


# --- numbers -----------------------------------------------------------------------------------


def same(printed: float, source: float, decimals: int | None) -> bool:
    tolerance = max(0.0 if decimals is None else 0.5 * 10.0**-decimals + 1e-12, 1e-9)
    return abs(printed) <= max(1e-8, tolerance) if abs(source) < 1e-12 else abs(printed - source) <= tolerance


def labels_of(prefix: str) -> list[Sequence[str]]:
    """Path parts allowed by the labels right before a number: one entry per label, longest labels win."""
    clause = _LABEL_END.split(prefix)[-1]
    hits = [(*m.span(), tokens) for p, tokens in _LABELS if (m := p.search(clause))]
    return [t for a, b, t in hits if not any(x <= a and b <= y and (x, y) != (a, b) for x, y, _ in hits)]


def meant(labels: Sequence[Sequence[str]], path: str) -> bool:
    return not labels or (len(labels) == 1 and any(t in path.lower() for t in labels[0]))


def formula_unit(formula: str, units: Sequence[str | None]) -> str | None:
    f = _GAPS.sub("", formula)
    if "/" in f:
        return "%" if "*100" in f or "100*" in f else ""
    return units[0] if len(set(units)) == 1 else ""


def carrying(t: Mapping, known: Known, value: Callable[[str, Sequence[float]], float | None]) -> Sequence[str]:
    """The paths that carry a number: those cited if one fits, else the inputs of the first formula that does."""
    if not t["sources"] and not t["formulas"]:
        return ()
    labels, unit = labels_of(t["local_prefix"]), t["unit"]
    decimals = len(_PRINTED.search(t["raw"]).group(1) or "") if _DIGIT.search(t["raw"]) else None
    direct = [p for p in t["sources"] if known.sound(p) and known.facts[p][1] == unit and same(t["value"], known.facts[p][0], decimals) and meant(labels, p)]
    if direct:
        return direct
    for f in t["formulas"]:
        inputs = f["inputs"]
        if inputs and all(map(known.sound, inputs)) and (len(inputs) != 1 or meant(labels, inputs[0])):
            result = value(f["formula"], [known.facts[p][0] for p in inputs])
            if result is not None and same(t["value"], result, decimals) and formula_unit(f["formula"], [known.facts[p][1] for p in inputs]) == unit:
                return inputs
    return ()


def about_itself(stripped: str, header: str | None) -> bool:
    """Whether a line or its table is about the result itself."""
    return _META_FIELD.match(stripped) is not None or _META_WORDS.search(stripped) is not None \
        or (header is not None and any(map(_SCORE_COLUMNS.search, cells(header))))


def is_data(t: Mapping, stripped: str, header: str | None, meta: bool) -> bool:
    """Whether a number is a claim and one on data; ``meta``: of a line about the result itself."""
    v, whole_bare = t["value"], "." not in t["digits"] and t["unit"] == ""
    tied, assumed = bool(t["sources"] or t["formulas"]), bool(t["assumptions"])
    if whole_bare:
        if 1900 <= v <= 2100 or 19000101 <= v <= 21001231 or (t["is_code"] and 100000 <= v <= 999999) or t["is_ordinal"] or t["opens_row"] or t["glued"]:
            return False
        if not tied and not assumed:
            if -10 <= v <= 10 and not _DATA_WORDS.search(stripped):
                return False
            if header is not None and _INDEX_COLUMNS.search(dict(enumerate(cells(header))).get(t["cell"], "")):
                return False
    if assumed:
        return False
    if tied:
        return True
    return not meta and (t["unit"] != "" or abs(v) > 10 or _DATA_WORDS.search(stripped) is not None)


def numbers(lines: Sequence[str], known: Known, value: Callable[[str, Sequence[float]], float | None]) -> list[tuple[int, int, int, int]]:
    """(line, data numbers, traced ones, paths that no earlier line leans on) of each line with data numbers.

    The context of a line - section, YAML block, table header - is that of ``lines.in_context``.
    """
    out, used = [], set()
    section, inside, meta_section = HEAD_SECTION, False, HEAD_SECTION.startswith(META_SECTIONS)
    rows = False  # of the block of table rows: a row above, rulers above, the last row before the first ruler
    rulers, candidate = 0, None
    for at, raw in enumerate(lines, 1):
        s = raw.strip(WHITE)
        if not s:
            continue
        header, heading, fence_end, in_yaml = None, False, False, inside
        if s[0] == "|":
            ruler = _RULER.fullmatch(s) is not None
            header = candidate if rulers else None
            if not ruler:
                candidate = s if not rulers else candidate
                rows = True
            elif rows:
                rulers += 1
        else:
            if s[0] == "`":
                opens, closes = s.startswith("```yaml"), s == "```"
                fence_end, in_yaml = closes and inside, opens or (inside and not closes)
                inside = opens or (inside and not closes)
            elif s[0] == "#" and _HEADING.match(s):
                heading, section = True, s.strip("#" + BLANK)
                meta_section = section.startswith(META_SECTIONS)
            if not fence_end:
                rows, rulers, candidate = False, 0, None
        if fence_end or not _DIGIT.search(s):
            continue
        meta = in_yaml or heading or meta_section or about_itself(s, header)
        if meta and "[" not in s:
            continue  # only evidence, which stands in brackets, makes data of its numbers
        data = [t for t in scan_line(s) if is_data(t, s, header, meta)]
        if data:
            carried = [c for c in (carrying(t, known, value) for t in data) if c]
            fresh = {p for c in carried for p in c} - used
            used |= fresh
            out.append((at, len(data), len(carried), len(fresh)))
    return out


# --- documents ------------------------------------------------------------------------------------


def judge(text: str, role: str, known: Known, gaps: Sequence[bool], expected: Sequence[Mapping], held: set[int]) -> tuple[int, list[tuple[int, int, int, int]]]:
    """The mask of the rules on one document but for pages and the breadth of its numbers, and these numbers by line."""
    lines = split_lines(text)
    cache: dict[tuple, float | None] = {}

    def value(formula: str, inputs: Sequence[float]) -> float | None:
        key = (formula, *inputs)
        if key not in cache:
            cache[key] = recompute(formula, [float(x) for x in inputs])
        return cache[key]

    out = checklist_mask(role, lines, expected, known)
    if sum(map(filled_row, region(text, NARRATIVE))) < 3:
        out |= R18
    if verified(text, held, known) < 3:
        out |= R22
    said = [(p, label) for p, label in _ASSERTIONS if p.search(text)]
    for x in lines if said else [x for x in lines if "[" in x]:
        cited: Sequence[str] = ()
        if "[" in x:
            tags = _CALC.findall(x)
            cited = cited_paths(x, tags)
            if not all(map(known.exists, cited)):
                out |= R23
            for t in tags:
                inputs = [known.value(p) for p in inputs_of(t)]
                if None in inputs or value(t.partition(";")[0].strip(WHITE), inputs) is None:
                    out |= R23
        for p, label in said:
            if p.search(x) and not backed(label, cited, known):
                out |= R24
    if contradicts(lines, text, gaps):
        out |= R24
    return out, numbers(lines, known, value)


def lists(column: pa.Array) -> tuple[list[int], pa.Array]:
    """Where the entries of each row end, and all entries."""
    ends, n = [], 0
    for size in pc.list_value_length(column).to_pylist():
        ends.append(n := n + (size or 0))
    return ends, column.flatten()


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``judged_rows`` without searches for cycles among the many small objects of a stretch: there are none."""
    searched = gc.isenabled()
    gc.disable()
    try:
        yield from judged_rows(batches)
    finally:
        if searched:
            gc.enable()


def judged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``JUDGED`` of documents: keys, text, mask so far, expected items as JSON, gaps, and the facts, paths and held rows of the company."""
    schema = pa.schema([("ts_code", pa.string()), ("expert_id", pa.string()), ("mask", pa.int64()), ("line", pa.int32()), ("data", pa.int32()),
                        ("traced", pa.int32()), ("paths", pa.int32()), ("page", pa.string())])
    items: dict[str | None, list] = {None: []}
    company, known, held = None, None, {}
    for batch in batches:
        for start in range(0, batch.num_rows, STRETCH):
            some = batch.slice(start, STRETCH)
            col = lambda name: some.column(name).to_pylist()  # noqa: E731, B023
            (fact_ends, fact), (path_ends, path), (held_ends, row) = (lists(some.column(n)) for n in ("facts", "bare", "held"))
            facts = list(zip(*(fact.field(i).to_pylist() for i in range(3))))
            paths, holds = path.to_pylist(), list(zip(*(row.field(i).to_pylist() for i in range(2))))
            out: list[tuple] = []
            for i, (code, role, text, mask, expected, gaps) in enumerate(zip(*map(col, ("ts_code", "expert_id", "text", "mask", "expected", "gaps")))):
                if code != company:
                    before = lambda ends: ends[i - 1] if i else 0  # noqa: E731, B023
                    company, known, held = code, Known(facts[before(fact_ends) : fact_ends[i]], paths[before(path_ends) : path_ends[i]]), {}
                    for e, r in holds[before(held_ends) : held_ends[i]]:
                        held.setdefault(e, set()).add(r)
                if expected not in items:
                    items[expected] = json.loads(expected)
                broken, lines = judge(text, role, known, gaps or (), items[expected], held.get(role, set()))
                first = lines.pop(0)[1:] if lines and lines[0][0] == 1 else (0, 0, 0)
                out.append((code, role, mask | broken, 1, *first, None))
                out += [(code, role, mask | broken, *x, None) for x in lines]
                out += [(code, role, mask | broken, 0, 0, 0, 0, p) for p in logged_pages(text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
