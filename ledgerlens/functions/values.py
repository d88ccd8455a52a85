"""Scalar rules on columns.

Everything here is a plain column expression, so it stays inside whole-stage
code generation.  NULL means *unknown* and is never read as zero; non-finite
numbers become NULL; divisions by zero become NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

YUAN_PER_YI = 1e8  # 100 million
WAN_PER_YI = 1e4  # 10 thousand of 10 thousand


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- numbers -----------------------------------------------------------------


def finite(x: Column | str) -> Column:
    """Double, or NULL when the input does not parse or is not finite."""
    d = _c(x).try_cast("double")
    return F.when(F.abs(d) < float("inf"), d)  # NaN sorts above infinity


def vendor_number(x: Column | str) -> Column:
    """Number written with thousands separators and an optional percent sign."""
    return finite(F.trim(F.regexp_replace(_c(x).cast("string"), "[,%]", "")))


def strict_sum(parts: Sequence[Column | str]) -> Column:
    """Sum that is NULL as soon as one part is unknown."""
    return reduce(lambda a, b: a + b, [_c(p) for p in parts])


def rounded(x: Column | str, digits: int = 2) -> Column:
    """Reporting form.  Half away from zero on the printed value, so a tie may end one last digit
    away from rounding the binary float."""
    return F.round(_c(x), digits)


def yi(yuan: Column | str) -> Column:
    """yuan -> 100 million yuan, two decimals."""
    return rounded(finite(yuan) / F.lit(YUAN_PER_YI))


def yi_from_wan(wan: Column | str) -> Column:
    """10 thousand yuan -> 100 million yuan, two decimals."""
    return rounded(finite(wan) / F.lit(WAN_PER_YI))


def wan_from_yuan(yuan: Column | str) -> Column:
    """yuan -> 10 thousand yuan; accepts text with thousands separators."""
    return finite(F.regexp_replace(_c(yuan).cast("string"), ",", "")) / F.lit(1e4)


def ratio_pct(a: Column | str, b: Column | str) -> Column:
    """a / b in percent, unrounded; NULL on an unknown part or a zero base."""
    return F.try_divide(_c(a), _c(b)) * 100


def pct(a: Column | str, b: Column | str) -> Column:
    """``ratio_pct`` with two decimals, the reporting form."""
    return rounded(ratio_pct(finite(a), finite(b)))


def cagr_pct(start: Column, end: Column, years: Column) -> Column:
    """Compound growth in percent; NULL unless both ends are positive and years > 0."""
    ok = (start > 0) & (end > 0) & (years > 0)
    return F.when(ok, (F.pow(end / start, F.lit(1.0) / years) - 1) * 100)


def yoy_pct(current: Column | str, previous: Column | str) -> Column:
    return (F.try_divide(_c(current), _c(previous)) - 1) * 100


def pre_close(close: Column | str, change: Column | str) -> Column:
    return rounded(_c(close) - _c(change))


def free_cash_flow(ocf: Column | str, capex: Column | str) -> Column:
    """Operating cash flow minus capital expenditure; never the investing total."""
    return _c(ocf) - _c(capex)


def interest_debt() -> Column:
    return strict_sum(["st_borr", "lt_borr", "bonds_payable"])


# --- dates and codes -----------------------------------------------------------


def compact_date(x: Column | str) -> Column:
    """Any of 2026-07-30, 2026/07/30, 20260730 (with a time part) -> 20260730; blank stays blank."""
    return F.substring(F.regexp_replace(F.coalesce(_c(x).cast("string"), F.lit("")), "[-/]", ""), 1, 8)


def hyphen_date(x: Column | str) -> Column:
    c = compact_date(x)
    return F.when(
        F.length(c) == 8,
        F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2)),
    ).otherwise(_c(x).cast("string"))


def as_date(x: Column | str) -> Column:
    """Text in any accepted shape -> date, NULL when blank or not a date."""
    return F.try_to_date(compact_date(x), "yyyyMMdd")


def ymd(x: Column | str) -> Column:
    return F.date_format(_c(x), "yyyyMMdd")


def known_date(ann: Column | str = "ann_date", f_ann: Column | str | None = "f_ann_date") -> Column:
    """The day a statement became public; NULL rows are invisible to as-of reads."""
    return _c(ann) if f_ann is None else F.coalesce(_c(ann), _c(f_ann))


def fiscal_year_available(as_of: Column) -> Column:
    """Newest fiscal year that must be public: last year from May on, else the one before."""
    return F.year(as_of) - F.when(F.month(as_of) >= 5, 1).otherwise(2)


def quarter_no(end_date: Column | str) -> Column:
    """1..4 for a quarter end, NULL for any other day."""
    key = F.date_format(_c(end_date), "MMdd")
    return (
        F.when(key == "0331", 1).when(key == "0630", 2).when(key == "0930", 3).when(key == "1231", 4)
    )


def statement_type(x: Column | str) -> Column:
    """Report type with every blank spelling as NULL."""
    t = F.trim(_c(x).cast("string"))
    return F.when(~t.isin("", "None", "nan"), t)


def normalize_code(x: Column | str) -> Column:
    """Six digits with an optional exchange -> ``600519.SH``; NULL when undecidable."""
    raw = F.upper(F.trim(F.coalesce(_c(x).cast("string"), F.lit(""))))
    symbol = F.regexp_extract(raw, r"^(\d{6})(\.(SH|SZ|BJ))?$", 1)
    given = F.regexp_extract(raw, r"^(\d{6})(\.(SH|SZ|BJ))?$", 3)
    first = F.substring(symbol, 1, 1)
    inferred = (
        F.when(first.isin("5", "6", "9"), "SH")
        .when(first.isin("0", "1", "2", "3"), "SZ")
        .when(first.isin("4", "8"), "BJ")
    )
    return F.when(
        symbol != "", F.concat(symbol, F.lit("."), F.when(given != "", given).otherwise(inferred))
    )


def code_symbol(x: Column | str) -> Column:
    return F.substring_index(_c(x), ".", 1)


def code_exchange(x: Column | str) -> Column:
    return F.try_element_at(F.split(_c(x), r"\."), F.lit(2))


# --- labels --------------------------------------------------------------------


def pmi_band(v: Column | str) -> Column:
    v = _c(v)
    return (
        F.when(v >= 52, "expansion_strong")
        .when(v >= 50, "expansion_mild")
        .when(v >= 48, "contraction_edge")
        .when(v.isNotNull(), "contraction_weak")
    )


def money_gap_band(gap: Column | str) -> Column:
    g = _c(gap)
    return (
        F.when(g < -5, "very_low_activity")
        .when(g < -2, "low_activity")
        .when(g > 2, "high_activity")
        .when(g.isNotNull(), "normal")
    )


def infer_unit(path: Column | str) -> Column:
    """Unit a fact carries, read from its path."""
    p = F.lower(_c(path))
    leaf = F.substring_index(p, ".", -1)
    return (
        F.when(leaf.isin("count", "period_count", "quarter") | leaf.endswith("_count"), "")
        .when(p.contains("_yi"), "亿")
        .when(p.contains("_wan"), "万")
        .when(reduce(or_, [p.contains(x) for x in ("pct", "margin", "cagr", "rate")]), "%")
        .otherwise("")
    )


def shown_decimals(raw: Column | str) -> Column:
    """Digits after the point in a number as it was printed; NULL when nothing was printed."""
    number = r"-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?"
    return F.when(_c(raw).rlike(r"\d"), F.length(F.regexp_extract(_c(raw), number, 1)))


def display_tolerance(decimals: Column) -> Column:
    half_unit = F.lit(0.5) * F.pow(F.lit(10.0), -decimals) + F.lit(1e-12)
    return F.greatest(F.coalesce(half_unit, F.lit(0.0)), F.lit(1e-9))


def display_equal(printed: Column, source: Column, decimals: Column) -> Column:
    """Equal up to half a unit of the last printed digit."""
    tol = display_tolerance(decimals)
    near_zero = F.abs(printed) <= F.greatest(F.lit(1e-8), tol)
    return F.when(F.abs(source) < 1e-12, near_zero).otherwise(F.abs(printed - source) <= tol)


def cjk_count(text: Column | str) -> Column:
    return F.regexp_count(_c(text), F.lit("[一-鿿]"))
